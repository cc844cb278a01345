"""Declared rules and alerts, rules with windows and outputs, inhibition over time, typed batches as arrays."""

import pytest
from pyspark.sql import functions as F

from comparison import connect, duck_rows, spark_rows
from eventspark.operators import ingest, observe, rules
from eventspark.plans import all_queries, all_sql
from eventspark.plans.configured import DECLARED, RULES


@pytest.mark.parametrize("name", [
    "declared_rules", "declared_output", "alert_inhibit_while", "alert_error_rate", "alert_latency", "alert_for", "fraud_rule", "rule_stages", "backtest"])
def test_queries(spark, medium, name):
    found = spark_rows(all_queries()[name](spark, medium))
    assert found[1] and found == duck_rows(connect(medium), all_sql()[name])


@pytest.mark.parametrize("name", ["alert_inhibit_while", "alert_error_rate", "alert_latency"])
def test_queries_with_hot_keys(spark, medium, cut, name):
    assert spark_rows(all_queries()[name](spark, medium)) == duck_rows(connect(medium), all_sql()[name])


def view(spark, rows):
    return spark.createDataFrame(rows, "userId string, amount double, at string").withColumn("ts", F.to_timestamp("at")).drop("at")


def test_outputs_are_upserted_by_window(spark, tmp_path):
    path = str(tmp_path / "out")
    declared = spark.createDataFrame(DECLARED, RULES)
    run = lambda rows: rules.rule_outputs(spark, declared, {"user_events": view(spark, rows)}, "ts")["user_activity_hourly"]
    first = [("a", 1.0, "2024-01-01 10:05:00"), ("a", 1.0, "2024-01-01 10:59:59"), ("b", 1.0, "2024-01-01 11:00:00")]
    rules.upsert_output(run(first), path)
    rules.upsert_output(run([("b", 2.0, "2024-01-01 11:10:00"), ("b", 1.0, "2024-01-01 11:00:00"), ("c", None, "2024-01-01 12:00:00")]), path)
    stored = lambda: sorted((r.window_start.hour, r.userId, r.activity_count) for r in spark.read.parquet(path).collect())
    assert stored() == [(10, "a", 2), (11, "b", 2), (12, "c", 1)]
    rules.upsert_output(run(first[2:]), path)
    assert stored() == [(10, "a", 2), (11, "b", 1), (12, "c", 1)]


def test_rules_leave_the_sessions_views_alone(spark):
    spark.range(1).createOrReplaceTempView("user_events")
    before = {t.name for t in spark.catalog.listTables()}
    found = rules.run_rules(spark, spark.createDataFrame(DECLARED, RULES), {"user_events": view(spark, [("a", 2000.0, "2024-01-01 10:07:00")])}, ts="ts")
    assert {t.name for t in spark.catalog.listTables()} == before and spark.table("user_events").columns == ["id"]
    assert sorted((r.rule_id, '"window_start":"2024-01-01T10:0' in r.result_data) for r in found.collect()) == [("fraud_detection", True), ("user_activity_aggregation", True)]
    spark.catalog.dropTempView("user_events")
    with pytest.raises(ValueError, match="no view has the column"):
        rules.run_rules(spark, spark.createDataFrame(DECLARED, RULES), {"user_events": spark.range(1)}, ts="ts")
    commands = spark.createDataFrame([("bad", 1, "SQL", "DROP TABLE x", "{}", True)], RULES)
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        rules.run_rules(spark, commands, {})


def test_a_warning_is_dropped_only_while_a_critical_fires(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [(1, "critical", None, at(2), at(4)), (2, "warning", "", at(1), None), (3, "warning", None, at(2), None), (4, "warning", None, at(4), None),
            (5, "warning", "x", at(3), None), (6, "critical", None, at(3), at(6)), (7, "warning", None, at(5), None), (8, None, None, at(5), None), (9, "critical", "y", at(5), None),
            (10, "warning", "y", at(9), None), (11, "warning", "y", at(4), None)]
    alerts = spark.createDataFrame([(n, "down", s, d, "i", a, u) for n, s, d, a, u in rows], "n int, alertname string, severity string, dev string, instance string, ts string, until string")
    alerts = alerts.withColumns({c: F.to_timestamp(c) for c in ("ts", "until")})
    found = observe.inhibit_while(alerts, "until")
    assert found.columns == alerts.columns
    assert sorted(r.n for r in found.collect()) == [1, 2, 5, 6, 8, 9, 11]


def test_declared_alerts_fire(spark):
    rows = [("GET", "/a", 503 if k % 2 else 202, 0.25 if k >= 3600 else 0.001, 1_704_067_200 + k) for k in range(7200)]
    rows = [r for r in rows if r[2] == 202 or r[4] < 1_704_067_200 + 1800]
    requests = spark.createDataFrame(rows, "method string, endpoint string, status int, duration_seconds double, at long").withColumn("ts", F.timestamp_seconds("at"))
    errors = observe.high_error_rate(requests).collect()
    assert [(r.alertname, r.severity, r.status) for r in errors] == [("HighErrorRate", "warning", "503")]
    # Half a request per second is above 0.1 once a minute of the window has errors, and until one is left.
    assert (errors[0].started_at.minute, errors[0].ended_at.hour, errors[0].ended_at.minute) == (1, 0, 33)
    slow = observe.high_latency(requests).collect()
    assert len(slow) == 1 and slow[0].started_at.hour == 1 and slow[0].started_at.minute == 0


def test_typed_batches_as_arrays(spark):
    event = "struct<id:string,type:string,source:string,data:string>"
    rows = [("b1", [("1", "t", "s", "{}"), ("2", "", "s", "{}")]), ("b2", []), ("b3", None)]
    events, refused = ingest.open_batches(spark.createDataFrame(rows, f"batch string, events array<{event}>"), "batch")
    assert sorted(map(tuple, refused.collect())) == [("b2", "InvalidArgument", "batch cannot be empty"), ("b3", "InvalidArgument", "batch cannot be empty")]
    results = ingest.ingest_batch(events, "batch", "idx").orderBy("idx").collect()
    assert [(r.batch, r.idx, r.status) for r in results] == [("b1", 0, "ACCEPTED"), ("b1", 1, "REJECTED")]


def test_many_types_in_one_plan(spark):
    import random

    from eventspark.operators import joins

    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 2, None]), rng.randrange(4000), f"t{rng.randrange(10_000)}" if k % 3 else rng.choice("ab")) for k in range(600)]
    frame = spark.createDataFrame(rows, "k int, at long, type string").withColumn("ts", F.timestamp_seconds("at"))
    want = {}
    for ka, ta, a in rows:
        for kb, tb, b in rows:
            if ka == kb and 0 < tb - ta <= 100:
                want[a, b] = want.get((a, b), 0) + 1
    found = joins.type_correlation(frame, "k", "100s", "ts", "type")
    assert {(r.type_a, r.type_b): r.pairs for r in found.collect()} == want
    assert joins.type_correlation(frame.limit(0), "k", "100s", "ts", "type").count() == 0


@pytest.mark.parametrize("name", ["http_batch_accepted", "interval_join_left", "interval_join_view_purchase", "type_correlation"])
def test_joins_and_batches(spark, medium, name):
    assert spark_rows(all_queries()[name](spark, medium)) == duck_rows(connect(medium), all_sql()[name])


def test_orders_are_orders(spark):
    rows = [(k % 3, k * 7 % 5, k) for k in range(60)]
    frame = spark.createDataFrame(rows, "priority int, at int, n int").withColumn("timestamp", F.timestamp_seconds("at")).repartition(7)
    assert [r.n for r in ingest.by_priority(frame, tie="n").collect()] == [n for *_, n in sorted(rows, key=lambda r: (-r[0], r[1], r[2]))]
    results = spark.createDataFrame([(k % 4, k) for k in range(50)], "b int, i int").repartition(6)
    assert [(r.b, r.i) for r in ingest.batch_results(results, "b", "i").collect()] == sorted((k % 4, k) for k in range(50))


def test_a_reset_checkpoint_does_not_refuse_rows_again(spark, tmp_path):
    from eventspark.schema import EVENTS_TABLE
    from eventspark.streaming import append_history

    source = str(tmp_path / "in")
    rows = spark.range(4).select(*[(F.when(F.col("id") > 0, F.col("id").cast("string")) if f.name == "event_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS_TABLE.fields])
    rows.write.parquet(source)
    stream = lambda: spark.readStream.schema(EVENTS_TABLE).parquet(source)
    append_history(stream(), str(tmp_path / "h"), str(tmp_path / "c1")).awaitTermination()
    with pytest.raises(Exception, match="does not know"):
        append_history(stream(), str(tmp_path / "h"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "h_rejected")).count() == 1 and spark.read.parquet(str(tmp_path / "h")).count() == 3
