"""Merged micro-batch folders, rollups with sketches, and appends that ask a filter before they read the history."""

import random

import pytest
from pyspark.sql import functions as F

from comparison import connect, duck_rows, spark_rows
from eventspark.operators import compaction, id_filter, rollups, store
from eventspark.operators.compaction import compact, live_folders, read_live
from eventspark.plans import all_queries, all_sql
from eventspark.schema import EVENTS_TABLE
from eventspark.streaming.sinks import compact_rollup, read_rollup


def put(spark, path, run, number, rows=3):
    frame = spark.range(rows).selectExpr(f"'{run}' run", f"{number}L number", "id")
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={run}_{number}")


def content(spark, path):
    return sorted(tuple(r) for r in read_live(spark, path).select("batch_id", "run", "number", "id").collect())


def test_many_micro_batches_stay_in_few_folders(spark, tmp_path):
    path, want, opened = str(tmp_path / "t"), [], []
    for n in range(60):
        put(spark, path, "r", n, 1)
        want.append((f"r_{n}", "r", n, 0))
        if n % 4 == 3:
            compact(spark, path, fanout=4)
            opened.append(live_folders(spark, path))
            if n % 16 == 15:
                assert content(spark, path) == sorted(want)
    assert content(spark, path) == sorted(want)
    # Three folders a level and the micro-batches since.
    assert max(opened) <= 3 * 3 + 5
    assert len(compaction.batches(compaction.Folder(spark, path))) < 12


@pytest.mark.parametrize("at", ["write", "publish", "clean"])
def test_a_failure_between_steps_loses_and_doubles_nothing(spark, tmp_path, at):
    path = str(tmp_path / "t")
    for n in range(6):
        put(spark, path, "a", n)
        put(spark, path, "b", n)
    want = content(spark, path)

    def fail(step):
        if step == at:
            raise RuntimeError(step)

    with pytest.raises(RuntimeError):
        compact(spark, path, fanout=4, step=fail)
    assert content(spark, path) == want
    put(spark, path, "a", 5)  # the newest of a run is written again
    assert content(spark, path) == want
    compact(spark, path, fanout=4)
    assert content(spark, path) == want
    put(spark, path, "a", 2)  # a covered one is written again
    assert content(spark, path) == want
    assert compaction.runs(spark, path) == {"a", "b"}


def test_two_compactions_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(6):
        put(spark, path, "a", n)
    want = content(spark, path)

    def other(step):
        if step == "publish":
            compaction.Folder(spark, path).publish("_manifest/00000001", '{"folders": [], "covered": {}}')

    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        compact(spark, path, fanout=4, step=other)
    assert content(spark, path) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_live(spark, str(tmp_path / "none"))


AGGS = {
    "n": ("count",), "low": ("min", "value"), "mean": ("avg", "value"), "spread": ("stddev", "value"), "p90": ("percentile", "value", 0.9),
    "users": ("distinct", "user_id"),
}


def test_a_compacted_rollup_gives_the_same_within_its_errors(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "r")
    for n in range(12):
        part = events.filter(F.pmod("event_id", F.lit(12)) == n)
        rollups.partial_rollup(part, "7d", ["event_type"], AGGS, "ts").coalesce(1).write.parquet(f"{path}/batch_id=run_{n}")
    keys = ["window_start", "event_type"]
    figures = lambda df: {tuple(r[k] for k in keys): r for r in df.collect()}
    before = figures(read_rollup(spark, path, ["event_type"], AGGS))
    stored = compact_rollup(spark, path, ["event_type"], AGGS, fanout=5)
    assert stored == 1 and live_folders(spark, path) == 2
    assert read_live(spark, path).count() <= 2 * len(before)
    after = figures(read_rollup(spark, path, ["event_type"], AGGS))
    grouped = events.groupBy(F.window("ts", "7 days").start.alias("window_start"), "event_type").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"),
        F.sort_array(F.collect_list("value")).alias("values"), F.countDistinct("user_id").alias("users"))
    exact = figures(grouped)
    assert set(before) == set(after) == set(exact)
    for key, r in after.items():
        e = exact[key]
        assert (r.n, r.low) == (e.n, e.low)
        assert r.mean == pytest.approx(e.mean) and (r.spread is None and e.n == 1 or r.spread == pytest.approx(e.spread))
        below, upto = sum(v < r.p90 for v in e["values"]) / e.n, sum(v <= r.p90 for v in e["values"]) / e.n
        assert max(below - 0.9, 0.9 - upto) <= 2 * rollups.KLL_RANK_ERROR + 1 / e.n
        assert abs(r.users - e.users) <= max(1, 4 * rollups.HLL_ERROR * e.users)


def test_rollups_of_nothing(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", None, None)], "ts string, value double, user_id int").withColumn("ts", F.to_timestamp("ts"))
    keys = []
    found = rollups.rollup_values(rollups.maintain_rollup(rows, rollups.partial_rollup(rows, "1h", keys, AGGS, "ts"), "1h", keys, AGGS, "ts"), keys, AGGS)
    assert tuple(found.first())[2:] == (2, None, None, None, None, 0)
    with pytest.raises(ValueError, match="has no mode"):
        rollups.partial_rollup(rows, "1h", keys, {"x": ("mode", "value")}, "ts")


def history(spark, ids, month=1):
    rows = [(f"e{i}", f"2024-{month:02d}-{1 + i % 28:02d} 00:00:00") for i in ids]
    frame = spark.createDataFrame(rows, "event_id string, ts string")
    values = {"event_id": F.col("event_id"), "event_timestamp": F.to_timestamp("ts")}
    return frame.select(*[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in EVENTS_TABLE.fields])


def test_appends_of_new_ids_read_no_history(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    looked = []
    real = store._looked_up
    monkeypatch.setattr(store, "_looked_up", lambda rows, maybe: looked.append(sorted(r.event_id for r in maybe.collect())) or real(rows, maybe))
    store.append_events(history(spark, range(100)), path)
    store.append_events(history(spark, range(1000, 1050), 2), path)
    assert looked == []
    store.append_events(history(spark, [5, 5, 2000, 1001], 3), path)
    assert looked == [["e1001", "e5"]]
    store.append_events(history(spark, [7, 3000], 3), path, within_month=True)  # of another month: not looked for
    assert looked == [["e1001", "e5"]]
    got = sorted(r.event_id for r in spark.read.parquet(path).collect())
    assert got == sorted([f"e{i}" for i in [*range(100), *range(1000, 1050), 2000, 3000, 7]])


def test_tables_without_a_filter_and_merged_filters(spark, tmp_path):
    path = str(tmp_path / "h")
    store._write_by_month(history(spark, range(50)), "event_timestamp", path, "append")
    for k in range(12):
        store.append_events(history(spark, [k, 100 + k]), path)
    folder = f"{path}/_ids"
    before = live_folders(spark, folder)
    assert id_filter.compact_ids(spark, path) == 1 and live_folders(spark, folder) < before
    id_filter.rebuild(spark.read.parquet(path), path, 8)
    store.append_events(history(spark, [*range(60), *range(100, 112), 500]), path)
    assert spark.read.parquet(path).count() == 60 + 12 + 1


def test_the_filter_misses_nothing_and_seldom_errs(spark, tmp_path):
    path = str(tmp_path / "h")
    rng = random.Random(1)
    ids = [f"{rng.random()}" for _ in range(20_000)]
    frame = spark.createDataFrame([(i, "2024-01") for i in ids[:10_000]], "event_id string, event_month string")
    spark.conf.set(id_filter.BLOCKS_CONF, "4")
    try:
        id_filter.add_ids(frame, path)
    finally:
        spark.conf.unset(id_filter.BLOCKS_CONF)
    maybe = {r.event_id for r in id_filter.maybe_stored(spark.createDataFrame([(i,) for i in ids], "event_id string"), path).collect()}
    assert set(ids[:10_000]) <= maybe and len(maybe) < 10_400


@pytest.mark.parametrize("name", ["rollup_sketches", "rollup_hourly"])
def test_queries(spark, medium, name):
    assert spark_rows(all_queries()[name](spark, medium)) == duck_rows(connect(medium), all_sql()[name])
