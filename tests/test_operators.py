"""Operators on small fixtures: files, admission, rules, schemas, alerts and notifications."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventspark import functions as fn
from eventspark.operators import admission, dlq, joins, notify, observe, patterns, quality, registry, rules, store, windows
from eventspark.operators import sizes
from eventspark.plans.configured import RULES, SCHEMAS
from eventspark.plans.tables import Tables
from eventspark.sources import load_active, read_event_topic, read_logs, scan_events

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def events(spark, rows, columns="id long, k string, type string, s double"):
    df = spark.createDataFrame(rows, columns)
    micros = (F.col("s") * 1_000_000).cast("long") + int(START.timestamp()) * 1_000_000
    return df.withColumn("timestamp", F.timestamp_micros(micros)).drop("s")


# --- functions

def test_literals(spark):
    assert fn.parse_duration("5m") == 300 and fn.parse_duration("1h") == 3600
    with pytest.raises(ValueError):
        fn.parse_duration("soon")
    df = spark.createDataFrame([("5m", "1KB"), ("1h", "1MB"), ("x", "7GB")], "d string, z string")
    rows = df.select(fn.parse_duration(F.col("d")).alias("d"), fn.parse_size(F.col("z")).alias("z")).collect()
    assert [r.d for r in rows] == [300.0, 3600.0, None]
    assert [r.z for r in rows] == [1024, 1024**2, 10 * 1024**2]


def test_templates_and_backoff(spark):
    df = spark.createDataFrame([("Hi ${name}, ${name} ${x} ${gone}", {"name": "A$b", "x": None})], "b string, v map<string,string>")
    assert df.select(fn.render_template(F.col("b"), F.col("v"))).first()[0] == "Hi A$b, A$b  ${gone}"
    times = spark.createDataFrame([(START, n) for n in range(3)], "t timestamp, n int")
    waits = times.select(fn.elapsed_ms(F.col("t"), fn.backoff(F.col("t"), F.col("n"), 30)).alias("w")).collect()
    assert [r.w for r in waits] == [30_000, 60_000, 120_000]


def test_config_values(spark):
    df = spark.createDataFrame([('{"threshold": 1000, "window": "5m"}',)], "c string")
    row = df.select(fn.config_value(F.col("c"), "$.threshold").cast("double"), fn.config_value(F.col("c"), "$.window")).first()
    assert tuple(row) == (1000.0, "5m")


# --- admission

def simulate(times, rate, burst):
    tokens, last, allowed = float(burst), times[0], []
    for now in times:
        tokens, last = min(burst, tokens + (now - last) * rate), now
        allowed.append(tokens >= 1 - 1e-9)
        tokens -= allowed[-1]
    return allowed


def test_burst_of_two(spark):
    df = events(spark, [(i, "a", "t", 0.0) for i in range(3)])
    admitted = admission.token_bucket(df, "k", rate=2, burst=2)
    assert [r.allowed for r in admitted.orderBy("id").collect()] == [True, True, False]


@pytest.mark.parametrize("key, limited, loads", [
    (None, False, [5, 60, 0.5, 11]), ("k", False, [60, 8]), (None, True, [5, 60, 0.5, 11]), ("k", True, [300]), ("k", True, [60, 8]),
])
def test_token_bucket_against_a_walk(spark, key, limited, loads, request):
    if limited:
        request.getfixturevalue("cut")
        spark.conf.set("eventspark.rowsPerGroup", "60")
    random.seed(5)
    rows, now = [], 0.0
    for i in range(2000):
        # Calm, overload, pause, load near the rate, in turn; or overload only.
        now += random.expovariate(loads[i // 100 % len(loads)])
        rows.append((i, f"key-{i % 7 // 4}", "t", round(now, 6)))
    found = {r.id: r.allowed for r in admission.token_bucket(events(spark, rows), key, rate=10, burst=5).collect()}
    groups = {}
    for i, k, _, s in rows:
        groups.setdefault(k if key else 0, []).append((i, s))
    for members in groups.values():
        wanted = simulate([s for _, s in members], 10, 5)
        assert [found[i] for i, _ in members] == wanted
    assert 0 < sum(found.values()) < len(rows)


# --- store

def history(spark, n, start=0):
    df = spark.range(start, start + n)
    return df.select(
        F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("tenant_id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.lit("{}").alias("event_data"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 86_400).alias("event_timestamp"),
        F.lit(None).cast("timestamp").alias("processing_timestamp"), F.lit("a").alias("partition_key"),
        F.lit(None).cast("string").alias("offset_info"), F.lit(None).cast("timestamp").alias("created_at"),
    )


@pytest.mark.parametrize("within_month", [False, True])
def test_history_round_trip(spark, tmp_path, within_month):
    path = str(tmp_path / "events")
    store.append_events(history(spark, 100), path, within_month)
    store.append_events(history(spark, 120).unionByName(history(spark, 120)), path, within_month)
    assert scan_events(spark, path).count() == 120
    some = scan_events(spark, path, datetime(2024, 2, 10), datetime(2024, 3, 5), "t1", ["a"])
    days = [r.event_timestamp for r in some.collect()]
    assert days and all(datetime(2024, 2, 10) <= d < datetime(2024, 3, 5) for d in days)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    some = scan_events(spark, path, datetime(2024, 2, 10), datetime(2024, 3, 5), "t1", ["a"])
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and "PushedFilters: [" in plan
    assert "EqualTo(tenant_id,t1)" in plan


def test_large_arrivals_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sizes, "MAX_BROADCAST_ROWS", 10)
    new = store.new_events(history(spark, 60).unionByName(history(spark, 60)), history(spark, 50))
    assert sorted(int(r.event_id) for r in new.collect()) == list(range(50, 60))


def test_archive(spark, tmp_path):
    store.archive(history(spark, 70), str(tmp_path / "cold"))
    assert spark.read.parquet(str(tmp_path / "cold")).groupBy("event_month").count().count() == 3


def test_routes_are_written_per_output(spark, tmp_path):
    outputs = spark.createDataFrame([("lake", "PARQUET", "{}", True), ("hook", "WEBHOOK", '{"result_types":["x"]}', True)],
                                    "config_name string, sink_type string, sink_config string, is_active boolean")
    results = spark.createDataFrame([("1", "x"), ("2", "y")], "original_event_id string, result_type string")
    sent = []
    store.write_routes(store.route(results, outputs), str(tmp_path / "out"), {"WEBHOOK": lambda df, _: sent.extend(df.collect())})
    assert [json.loads(r.payload)["original_event_id"] for r in sent] == ["1"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert store.route(results, outputs.filter("not is_active")).count() == 0


def test_logs(spark, tmp_path):
    (tmp_path / "app.log").write_text("one\ntwo\n")
    rows = read_logs(spark, str(tmp_path), "application").orderBy("value").collect()
    assert [(r.value, r.job) for r in rows] == [("one", "application"), ("two", "application")]
    assert rows[0].path.endswith("app.log")


def test_topic_from_files(spark, tmp_path):
    spark.createDataFrame([("k", "{}", 3, 7)], "key string, value string, partition int, offset long").write.parquet(str(tmp_path / "t"))
    row = read_event_topic(spark, str(tmp_path / "t"), "parquet", streaming=False).first()
    assert (row.key, row.partition, row.offset, row.headers) == ("k", 3, 7, None)
    assert read_event_topic(spark, str(tmp_path / "t"), "parquet", max_per_trigger=1).isStreaming


# --- joins and patterns

def test_lookup_joins_above_the_limit(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    dim = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    for limit in (10, 1000):
        joined = sizes.join_lookup(big, dim, "k", "left", limit)
        assert joined.count() == 100 and joined.filter("v = 1").count() == 50


def test_interval_borders(spark):
    a = events(spark, [(1, "x", "a", 0.0)]).select("k", F.col("id").alias("a_id"), F.col("timestamp").alias("a_ts"))
    b = events(spark, [(i, "x", "b", s) for i, s in enumerate([0.0, 0.000001, 10.0, 10.000001])])
    b = b.select("k", F.col("id").alias("b_id"), F.col("timestamp").alias("b_ts"))
    assert sorted(r.b_id for r in joins.interval_join(a, b, "k", "10s").collect()) == [1, 2]
    lonely = joins.interval_join(a, b.filter("b_id = 3"), "k", "10s", how="left").collect()
    assert [(r.a_id, r.b_id) for r in lonely] == [(1, None)]


def test_a_gap_of_exactly_the_limit_splits_sessions(spark):
    df = events(spark, [(1, "x", "a", 0.0), (2, "x", "a", 59.999999), (3, "x", "a", 119.999999)])
    rows = windows.sessions(df, "1m", "k").orderBy("session_start").collect()
    assert [r.event_count for r in rows] == [2, 1]


def test_strict_needs_neighbours_relaxed_does_not(spark):
    df = events(spark, [(1, "x", "a", 0.0), (2, "x", "z", 1.0), (3, "x", "b", 2.0), (4, "x", "a", 3.0), (5, "x", "b", 4.0)])
    steps = [("a", F.col("type") == "a"), ("b", F.col("type") == "b")]
    assert [(r.a_id, r.b_id) for r in patterns.match_strict(df, "k", steps, "10s").collect()] == [(4, 5)]
    assert sorted((r.a_id, r.b_id) for r in patterns.match_relaxed(df, "k", steps, "10s").collect()) == [(1, 3), (4, 5)]
    assert patterns.match_relaxed(df, "k", steps, "1s").count() == 1


# --- rules and schemas

def test_rules_cannot_run_commands(spark):
    bad = spark.createDataFrame([("r", 1, "X", "DROP TABLE x", "{}", True)], RULES)
    with pytest.raises(PySparkException):
        rules.run_rules(spark, bad, {})


def test_rule_text_is_literal(spark):
    text = "SELECT id, concat('${', name) AS t FROM people"
    rule = spark.createDataFrame([("r", 1, "X", text, "{}", True)], RULES)
    people = spark.createDataFrame([(1, "n}")], "id int, name string")
    found = rules.run_rules(spark, rule, {"people": people}).first()
    assert json.loads(found.result_data)["t"] == "${n}"


def test_backtest_reports_broken_rules(spark):
    table = spark.createDataFrame(
        [("ok", 1, "X", "SELECT * FROM events", "{}", False), ("bad", 2, "X", "SELECT nothing FROM events", "{}", False)], RULES)
    df = spark.createDataFrame([("t", START)], "tenant_id string, event_timestamp timestamp")
    compared, problems = rules.backtest_rules(spark, table, df, START, START + timedelta(days=1))
    row = compared.first()
    assert (row.rule_id, row.active_matches, row.candidate_matches, row.difference) == ("ok", 0, 1, 1)
    assert [(p.rule_name, p.rule_version) for p in problems.collect()] == [("bad", 2)]


def test_latest_active_version(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, False)], "n string, v int, is_active boolean")
    assert [tuple(r) for r in load_active(df, "n", "v").collect()] == [("a", 2, True)]


def test_payload_kinds(spark):
    definition = ('{"type":"record","name":"R","fields":[{"name":"s","type":"string"},{"name":"n","type":["null","long"],"default":null},'
                  '{"name":"d","type":"double"},{"name":"l","type":{"type":"array","items":"string"}},{"name":"b","type":"boolean","default":true}]}')
    schemas = spark.createDataFrame([("t", 1, definition, "BACKWARD", True)], SCHEMAS)
    payloads = [
        {"s": "x", "n": None, "d": 1, "l": [], "b": False}, {"s": "x", "d": 1.5, "l": ["a"]},
        {"s": 1, "n": "x", "d": "1", "l": {}, "b": 0}, {"d": 2, "l": [], "more": 1}, [1],
    ]
    df = spark.createDataFrame([(i, "t", 1, json.dumps(p)) for i, p in enumerate(payloads)], "i int, type string, schema_version int, data string")
    rows = registry.check_payload(df, schemas).orderBy("i").collect()
    codes = [{e.field: e.code for e in r.payload_errors} for r in rows]
    assert codes == [
        {}, {}, {f: "wrong_type" for f in "sndlb"}, {"s": "missing", "more": "unknown"}, {"data": "not_an_object"},
    ]
    unknown = registry.check_payload(df.withColumn("type", F.lit("other")), schemas).first()
    assert not unknown.schema_found and unknown.payload_errors == []


@pytest.mark.parametrize("level, field, compatible", [
    ("BACKWARD", '{"name":"b","type":"int","default":1}', True), ("BACKWARD", '{"name":"b","type":"int"}', False),
    ("FORWARD", '{"name":"b","type":"int"}', True), ("FULL", '{"name":"b","type":"int"}', False), ("NONE", '{"name":"b","type":"int"}', True),
])
def test_compatibility_levels(spark, level, field, compatible):
    record = '{{"type":"record","name":"R","fields":[{{"name":"a","type":"int"}}{}]}}'.format
    schemas = spark.createDataFrame([("s", 1, record(""), level, True), ("s", 2, record("," + field), level, True)], SCHEMAS)
    row = registry.check_compat(schemas).first()
    assert (row.previous_version, row.is_compatible) == (1, compatible)


# --- quality, metrics, alerts

def test_masking(spark):
    df = spark.createDataFrame([("mail a.b@c.org or call +49 (30) 123-4567 now", None)], "t string, u string")
    row = quality.mask(df, ["t", "u"]).first()
    assert row.t == "mail <email> or call <phone> now" and row.u is None
    assert len(df.select(quality.pseudonym("t", "salt")).first()[0]) == 64


def test_tenants(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "tenant_id string")
    assert quality.for_tenant(df, "a").count() == 1 and quality.for_tenant(df, None).count() == 1


def test_counter_restarts(spark):
    df = events(spark, [(1, "m", "t", 0.0), (2, "m", "t", 60.0), (3, "m", "t", 120.0)])
    df = df.withColumn("value", F.expr("CASE id WHEN 1 THEN 100.0D WHEN 2 THEN 160.0D ELSE 30.0D END"))
    rates = observe.rate(df, "5m", ["k"], ts="timestamp").orderBy("id").collect()
    assert [round(r.rate * 300) for r in rates] == [0, 60, 90]


def test_alert_needs_the_whole_time(spark):
    df = events(spark, [(i, "a", "t", 60.0 * i) for i in range(12)]).withColumn("v", F.when(F.col("id") == 4, 0.0).otherwise(1.0))
    rows = observe.alert_for(df, ["k"], F.col("v") > 0.1, "5m", ts="timestamp").collect()
    assert [(r.sample_count, r.started_at, r.fired_at) for r in rows] == [(7, at(300), at(600))]


def test_inhibition(spark):
    df = spark.createDataFrame(
        [(1, "a", "critical", None, "i"), (2, "a", "warning", "", "i"), (3, "a", "warning", "d", "i"), (4, "b", "warning", None, "i"), (5, "a", "info", None, "i")],
        "n int, alertname string, severity string, dev string, instance string")
    assert sorted(r.n for r in observe.inhibit(df).collect()) == [1, 3, 4, 5]


def test_alert_grouping(spark):
    rows = [("up", "w", "1", 0.0), ("up", "w", "2", 5.0), ("up", "w", "1", 12.0), ("up", "w", "3", 25.0), ("up", "w", "1", 4000.0)]
    df = spark.createDataFrame(rows, "alertname string, severity string, dev string, s double")
    df = df.withColumns({"ts": F.timestamp_micros((F.col("s") * 1e6).cast("long") + 1_704_067_200_000_000), "instance": F.lit("i")})
    sent = observe.group_alerts(df).orderBy("notified_at").collect()
    assert [(r.notified_at, r.fresh_alerts, r.reason) for r in sent] == [(at(10), 2, "new"), (at(30), 1, "new"), (at(4000), 0, "repeat")]


def test_lag(spark):
    ends = spark.createDataFrame([(0, 10), (1, 5), (2, 3)], "partition int, end_offset long")
    done = spark.createDataFrame([(0, 4), (1, 9)], "partition int, committed_offset long")
    lags = observe.consumer_lag(ends, done)
    assert {r.partition: r.lag for r in lags.collect()} == {0: 6, 1: 0, 2: 3}
    assert tuple(observe.total_lag(lags).first()) == (9, 6)
    progress = {"sources": [{"endOffset": '{"t":{"0":4}}', "latestOffset": '{"t":{"0":10,"1":2}}'}]}
    assert observe.progress_lag(progress) == [("t", "0", 6), ("t", "1", 2)]


# --- dead letters and notifications

def test_retries_run_out(spark):
    letters = spark.createDataFrame([("1", 2, 3, START), ("2", 0, 3, START), ("3", 0, 3, at(99))],
                                    "original_event_id string, retry_count int, max_retries int, next_retry_at timestamp").withColumn("updated_at", F.lit(START))
    now = F.lit(at(10)).cast("timestamp")
    assert sorted(r.original_event_id for r in dlq.dlq_due(letters, now).collect()) == ["1", "2"]
    outcomes = spark.createDataFrame([("1", False), ("2", False)], "original_event_id string, succeeded boolean")
    after = {r.original_event_id: r for r in dlq.dlq_advance(letters, outcomes, now, 60).collect()}
    assert after["1"].state == "DEAD" and after["1"].next_retry_at is None and after["1"].retry_count == 3
    assert after["2"].state == "WAITING" and after["2"].next_retry_at == at(10 + 120)
    assert after["3"].state == "WAITING" and after["3"].next_retry_at == at(99)


def test_illegal_delivery_steps(spark):
    log = spark.createDataFrame(
        [("a", 1, "PENDING"), ("a", 2, "PROCESSING"), ("a", 3, "PROCESSING"), ("a", 4, "SENT"), ("b", 1, "PENDING"), ("b", 2, "SENT"), ("c", 1, "SENT")],
        "message_id string, seq int, status string")
    rows = {r.message_id: (r.status, r.illegal_steps) for r in notify.fold_status(log).collect()}
    assert rows == {"a": ("SENT", 0), "b": ("SENT", 1), "c": ("SENT", 1)}


# --- plans

def test_patterns_shuffle_once(spark, small):
    steps = [(name, F.col("event_type") == name) for name in ("view", "click", "purchase")]
    df = Tables(spark, small).events
    for found in (
        patterns.match_relaxed(df, "user_id", steps, "24h", ts="ts", id_col="event_id"),
        patterns.match_strict(df, "user_id", steps, "24h", ts="ts", id_col="event_id"),
        windows.sessions(df, "6h", "user_id", ts="ts", tie="event_id"),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_scans_read_only_what_they_need(spark, small):
    df = windows.user_activity(Tables(spark, small).events, user="user_id")
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in df._jdf.queryExecution().executedPlan().toString()
