"""Nothing is lost or taken for another: nulls, refused batches, zones, ids, templates, chained operators."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventspark.functions import render_template
from eventspark.operators import dlq, ingest, notify, observe, registry, sizes, store, windows
from eventspark.operators import validate as V
from eventspark.plans import all_queries
from eventspark.sources import decode_requests, explode_batch, history_range
from eventspark.sources.history import MONTH, month_of


def bodies(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "batch int, value string")


def test_http_batches_that_do_not_decode_are_refused(spark):
    good = {"type": "a", "source": "s", "data": {}}
    batch = lambda *items: json.dumps({"events": list(items)})
    df = bodies(spark, batch(good, good), "{", batch(), "{}", batch(*[good] * 101), batch(good, {"type": "a", "data": {}}), None, "[1]")
    accepted, summary = ingest.ingest_batch_http(explode_batch(df), "batch", "idx")
    rows = {r.batch: (r.event_count, r.processed_count, r.status_code, r.error) for r in summary.collect()}
    assert rows[0] == (2, 2, 202, None) and accepted.count() == 2
    assert rows[1] == rows[6] == rows[7] == (0, 0, 400, "invalid_json")
    assert [rows[k][2] for k in range(2, 6)] == [400] * 4 and rows[2][3].endswith("min") and rows[3][3].endswith("required")
    assert rows[4][3].endswith("max") and rows[5] == (2, 0, 400, "Field 'Source' failed validation: required")


def test_readme_pipeline_and_dead_letters(spark):
    text = spark.createDataFrame([('{"type":"a","source":"s","data":{"k":1}}',), ('{"type":"a","data":{}}',), ("no",)], "value string")
    accepted, rejected = ingest.ingest(decode_requests(text), protocol="http")
    assert accepted.count() == 1 and set(accepted.first().metadata) == {"request_id", "client_ip", "user_agent"}
    now = F.lit(datetime(2024, 2, 1)).cast("timestamp")
    letters = store.to_dlq(rejected, now)
    assert sorted(r.error_type for r in letters.collect()) == ["invalid_json", "validation_failed"]
    assert dlq.dlq_due(dlq.dlq_advance(letters, letters.select("original_event_id", F.lit(False).alias("succeeded")).limit(0), now, 60), now).count() == 2


def test_last_of_duplicate_keys_counts(spark):
    row = decode_requests(spark.createDataFrame([('{"type":"a","type":"b","source":"s","data":{"k":1,"k":2}}',)], "value string")).first()
    assert (row.decode_error, row.type, row.data) == (None, "b", '{"k":2}')


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_history_bounds_are_instants(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        hours = spark.range(96).select(F.timestamp_micros(F.lit(1_706_572_800_000_000) + F.col("id") * 3_600_000_000).alias("event_timestamp"))
        df = hours.withColumn(MONTH, month_of("event_timestamp"))
        assert {r[0] for r in df.select(MONTH).distinct().collect()} == {"2024-01", "2024-02"}
        east = timezone(timedelta(hours=9))
        assert history_range(df, datetime(2024, 2, 1, 0, tzinfo=east), datetime(2024, 2, 1, 19, tzinfo=east)).count() == 19
        assert history_range(df, datetime(2024, 1, 31), datetime(2024, 2, 1)).count() == 24
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rows_without_ids_are_given_back(spark, tmp_path):
    from eventspark.schema import EVENTS_TABLE

    df = spark.createDataFrame([("a",), (None,), (None,), ("a",)], "event_id string")
    for field in EVENTS_TABLE.fields[1:]:
        value = F.lit(datetime(2024, 1, 1)) if field.name == "event_timestamp" else F.lit(None)
        df = df.withColumn(field.name, value.cast(field.dataType))
    assert store.append_events(df, str(tmp_path / "h")).count() == 2
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "h")).collect()] == ["a"]


def test_routes_without_a_sink_type(spark, tmp_path):
    routed = spark.createDataFrame([("a", "HOOK", "{}", "1"), ("b", None, "{}", "2"), ("c", "PARQUET", "{}", "3")], store.ROUTED)
    store.write_routes(routed, str(tmp_path / "o"), {"HOOK": lambda df, path: df.write.parquet(path)})
    assert spark.read.parquet(str(tmp_path / "o" / "HOOK")).count() == 1
    assert sum(spark.read.parquet(str(tmp_path / "o" / f"config_name={c}")).count() for c in "bc") == 2
    outputs = spark.createDataFrame([("x", None, "{}", True)], "config_name string, sink_type string, sink_config string, is_active boolean")
    with pytest.raises(ValueError, match="no sink type"):
        store.route(spark.createDataFrame([("t",)], "result_type string"), outputs)


def test_message_ids_keep_parts_apart(spark):
    rows = [("1", "t", 1, "x|EMAIL", "SMS"), ("1", "t", 1, "x", "EMAIL|SMS"), ("1", "t", 1, None, "SMS"), ("1", "t", 1, "", "SMS")]
    df = spark.createDataFrame(rows, "id string, template_id string, template_version int, recipient string, channel string")
    assert df.select(notify.message_id()).distinct().count() == 4


def test_values_are_not_templates(spark):
    df = spark.createDataFrame([("${a}-${b}-${c}-${", {"a": "${b}", "b": "$1\\x", "z": "no"})], "t string, v map<string,string>")
    assert df.select(render_template(F.col("t"), F.col("v"))).first()[0] == "${b}-$1\\x-${c}-${"


def test_payload_text_must_be_an_object(spark):
    df = spark.createDataFrame([("a", "s", d) for d in ("{}", "[1]", "x", None, "1")], "type string, source string, data string")
    assert [r.error for r in V.validate_typed(df).collect()] == [None, V.DATA_OBJECT, V.DATA_OBJECT, V.DATA_REQUIRED, V.DATA_OBJECT]


def test_late_breach_has_its_time(spark):
    day = 86_400_000_000
    df = spark.range(5).select(
        F.lit("k").alias("k"), F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * day).alias("ts"), (F.col("id") / 1000).alias("value"))
    found = observe.trend_alert(df, ["k"], 4, 400.0, ["ts"]).orderBy("event_id").collect()[-1]
    assert found.slope_per_day == pytest.approx(0.001) and found.breach_at.year in range(3118, 3121)
    assert observe.trend_alert(df, ["k"], 4, 1e9, ["ts"]).orderBy("event_id").collect()[-1].breach_at is None


def test_enumerations_arrays_and_ranges(spark):
    fields = '[{"name":"i","type":"int"},{"name":"b","type":"bytes"},{"name":"e","type":{"type":"enum","name":"E","symbols":["A"]}},{"name":"a","type":{"type":"array","items":"string"}}]'
    schemas = spark.createDataFrame([("t", 1, '{"type":"record","name":"R","fields":%s}' % fields, "FULL", True)],
                                    "schema_name string, schema_version int, schema_definition string, compatibility_level string, is_active boolean")
    df = spark.createDataFrame([('{"i":3000000000,"b":7,"e":"ZZ","a":[1,2]}',), ('{"i":3,"b":"x","e":"A","a":["x"]}',)], "data string").withColumns({"type": F.lit("t"), "schema_version": F.lit(1)})
    rows = registry.check_payload(df, schemas).orderBy("data").collect()
    assert [sorted(e.field for e in r.payload_errors) for r in rows] == [[], ["a", "b", "e", "i"]] or [sorted(e.field for e in r.payload_errors) for r in rows] == [["a", "b", "e", "i"], []]


def test_exact_percentile_by_ranks(spark, cut):
    rows = [(k % 3 if k % 7 else None, float((k * 37) % 101)) for k in range(120)] + [(9, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    aggs = {"n": ("count",), "p": ("percentile", "v", 0.37), "q": ("percentile", "v", 0.9)}
    got = {r.k: (r.n, r.p, r.q) for r in windows.aggregate(df, ["k"], aggs).collect()}
    want = {r.k: (r.n, r.p, r.q) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.percentile("v", 0.37).alias("p"), F.percentile("v", 0.9).alias("q")).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) if want[k][1] is not None else got[k] == want[k] for k in want)


def test_few_large_rows_are_not_small(spark):
    df = spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert sizes.is_small(df) and not sizes.is_small(df, max_bytes=2000)


def test_a_round_of_dead_letters_does_not_repeat_the_rounds_before(spark, tmp_path):
    rows = [(k, k, "view", 1.0, None if k % 2 else "{}", datetime(2024, 1, 5)) for k in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    letters = all_queries()["dead_letter_rounds"](spark, str(tmp_path))
    plan = letters._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "parquet" not in plan
    want = {0: ("RESOLVED", 0), 1: ("DEAD", 3), 2: ("WAITING", 1)}
    found = {int(r.id): (r.state, r.retry_count) for r in letters.collect()}
    assert found == {k: want[k % 3] for k in range(60) if k % 2 or k % 17 == 0 or k % 19 == 0 or k % 23 == 0}
