"""Streams fed in time order give what the batch operators give."""

import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from comparison import rows
from eventspark.operators import admission, joins, observe, patterns, windows
from eventspark.plans.sequences import steps
from eventspark.plans.tables import ARRIVAL, Tables
from eventspark.streaming import (
    append_history, read_rollup, run_rules_stream, stream_alert_groups, stream_count_windows, stream_late,
    stream_match_relaxed, stream_threshold, stream_token_bucket, write_exactly_once, write_rollup,
)

FILES = 3


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Batch events and a factory of streams over them, as files in time order."""
    df = Tables(spark, "/root/testdata/sf0.001").events.withColumn("arrival", F.expr(ARRIVAL))
    df = df.persist()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder = tmp_path_factory.mktemp("feed")
    size = df.count() // FILES + 1
    for i in range(FILES):
        part = df.filter((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size))
        part.coalesce(1).write.parquet(str(folder / f"part-{i}"))
    base = folder / "all"
    base.mkdir()
    for i in range(FILES):
        source = next((folder / f"part-{i}").glob("*.parquet"))
        target = base / f"{i}.parquet"
        shutil.copy(source, target)
        os.utime(target, (1_700_000_000 + i * 10,) * 2)

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(base))

    yield df, stream
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def drain(stream, tmp_path, name="out") -> list:
    """Run a stream to its end and read what came out."""
    folder = Path(tmp_path) / name
    query = write_exactly_once(stream, str(folder / "data"), str(folder / "ckpt"))
    query.awaitTermination()
    return stream.sparkSession.read.parquet(str(folder / "data")).drop("batch_id")


def same(left, right):
    names = sorted(left.columns)
    a = rows(names, [tuple(r) for r in left.select(*names).collect()])
    b = rows(names, [tuple(r) for r in right.select(*names).collect()])
    assert a[1], "nothing to compare"
    assert a == b


def test_relaxed_match(feed, tmp_path):
    df, stream = feed
    funnel = steps("view", "click", "purchase")
    batch = patterns.match_relaxed(df, "user_id", funnel, "48h", ts="ts", id_col="event_id")
    same(drain(stream_match_relaxed(stream(), "user_id", funnel, "48h", "ts", "event_id"), tmp_path), batch)


def test_threshold(feed, tmp_path):
    df, stream = feed
    error = F.col("event_type") == "error"
    batch = patterns.match_threshold(df, "user_id", error, 3, "48h", ts="ts").select("event_id", "match_count")
    found = drain(stream_threshold(stream(), "user_id", error, 3, "48h", "ts", "event_id"), tmp_path)
    same(found.select("event_id", "match_count"), batch)


def test_count_windows(feed, tmp_path):
    df, stream = feed
    batch = windows.count_windows(df, 5, "user_id", ["ts", "event_id"]).filter("complete")
    found = drain(stream_count_windows(stream(), 5, "user_id", "ts", "event_id"), tmp_path)
    same(found.select("user_id", "window_index", "event_count", "complete"), batch)


def test_late_rows_are_told_apart(feed, tmp_path):
    df, stream = feed
    # Files hold arrival ranges up to a bounded disorder, so arrival order is taken within a file.
    found = drain(stream_late(stream(), "event_type", "1h", "arrival", "ts"), tmp_path)
    assert found.count() == df.count()
    assert 0 < found.filter("is_late").count() < df.count()


def test_token_bucket(feed, tmp_path):
    df, stream = feed
    batch = admission.token_bucket(df.select("event_id", "user_id", "ts"), "user_id", 0.00002, 2, "ts", "event_id")
    found = drain(stream_token_bucket(stream(), "user_id", 0.00002, 2, "ts", "event_id"), tmp_path)
    same(found.select("event_id", "allowed"), batch.select("event_id", "allowed"))


def test_alert_groups(feed, tmp_path):
    df, stream = feed
    def shaped(d):
        return d.select(
            "ts", F.col("event_type").alias("alertname"), F.lit("warning").alias("severity"),
            F.col("user_id").cast("string").alias("dev"), F.lit("x").alias("instance"),
        )

    batch = observe.group_alerts(shaped(df), "10m", "10m", "6h")
    found = drain(stream_alert_groups(shaped(stream()), "10m", "10m", "6h", delay="1s"), tmp_path)
    # Flushes behind the last watermark do not come out of a stream that ends.
    last = found.agg(F.max("notified_at")).first()[0]
    same(found, batch.filter(F.col("notified_at") <= F.lit(last)))


def test_closed_windows(feed, tmp_path):
    df, stream = feed
    aggs = {"n": ("count",), "high": ("max", "value")}
    batch = windows.tumbling(df, "1d", ["event_type"], aggs, ts="ts")
    found = drain(windows.tumbling(windows.with_watermark(stream(), "1h", "ts"), "1d", ["event_type"], aggs, ts="ts"), tmp_path)
    last = found.agg(F.max("window_start")).first()[0]
    same(found, batch.filter(F.col("window_start") <= F.lit(last)))


def test_closed_sliding_windows(feed, tmp_path):
    df, stream = feed
    aggs = {"n": ("count",)}
    batch = windows.sliding(df, "1d", "12h", ["event_type"], aggs, ts="ts")
    found = drain(windows.sliding(windows.with_watermark(stream(), "1h", "ts"), "1d", "12h", ["event_type"], aggs, ts="ts"), tmp_path)
    last = found.agg(F.max("window_start")).first()[0]
    same(found, batch.filter(F.col("window_start") <= F.lit(last)))


def test_closed_sessions(feed, tmp_path):
    df, stream = feed
    batch = windows.sessions(df, "6h", "user_id", ts="ts", tie="event_id")
    found = drain(windows.sessions(windows.with_watermark(stream(), "1h", "ts"), "6h", "user_id", ts="ts"), tmp_path)
    last = found.agg(F.max("session_end")).first()[0]
    same(found.select(*batch.columns), batch.filter(F.col("session_end") <= F.lit(last)))


def test_dedupe(feed, tmp_path):
    df, stream = feed
    doubled = stream().unionByName(stream())
    found = drain(windows.dedupe(doubled, "event_id", ts="ts", within="40d"), tmp_path)
    same(found.select("event_id"), df.select("event_id"))


def test_interval_join(feed, tmp_path):
    df, stream = feed
    def sides(d):
        a = d.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
        b = d.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
        return a, b

    batch = joins.interval_join(*sides(df), "user_id", "24h")
    a, b = sides(stream())
    a, b = windows.with_watermark(a, "1h", "a_ts"), windows.with_watermark(b, "1h", "b_ts")
    same(drain(joins.interval_join(a, b, "user_id", "24h"), tmp_path), batch)


def test_enriched_stream(feed, tmp_path, spark):
    df, stream = feed
    dim = df.groupBy("user_id").agg(F.max("event_type").alias("label"))
    found = drain(joins.enrich(stream(), dim, "user_id"), tmp_path)
    same(found.select("event_id", "label"), joins.enrich(df, dim, "user_id").select("event_id", "label"))


def test_replayed_batches_change_nothing(feed, tmp_path, spark):
    df, stream = feed
    for _ in ("first", "again"):
        query = write_exactly_once(stream(), str(tmp_path / "data"), str(tmp_path / "run"))
        query.awaitTermination()
        same(spark.read.parquet(str(tmp_path / "data")).select("event_id"), df.select("event_id"))
        # The last micro-batch was not committed, so it is run a second time.
        last = max((f for f in (tmp_path / "run" / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
        for f in (last, last.with_name(f".{last.name}.crc")):
            f.unlink(missing_ok=True)


def test_reset_checkpoint_neither_replaces_nor_repeats(feed, tmp_path, spark):
    df, stream = feed
    data = str(tmp_path / "data")
    write_exactly_once(stream().filter("event_id < 100"), data, str(tmp_path / "first")).awaitTermination()
    query = write_exactly_once(stream(), data, str(tmp_path / "reset"))
    with pytest.raises(Exception, match="does not know"):
        query.awaitTermination()
    write_exactly_once(stream().filter("event_id >= 100"), data, str(tmp_path / "other"), beside=True).awaitTermination()
    same(spark.read.parquet(data).select("event_id"), df.select("event_id"))


def test_history_is_appended_once(feed, tmp_path, spark):
    from eventspark.sources import scan_events

    df, stream = feed
    history = stream().select(
        F.col("event_id").cast("string").alias("event_id"), F.lit("t").alias("tenant_id"), "event_type",
        F.col("props").alias("event_data"), F.col("ts").alias("event_timestamp"),
        F.lit(None).cast("timestamp").alias("processing_timestamp"), F.lit(None).cast("string").alias("partition_key"),
        F.lit(None).cast("string").alias("offset_info"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    for run in ("first", "again"):
        append_history(history, str(tmp_path / "history"), str(tmp_path / run)).awaitTermination()
    stored = scan_events(spark, str(tmp_path / "history"))
    same(stored.select("event_id"), df.select(F.col("event_id").cast("string").alias("event_id")))
    assert stored.filter("processing_timestamp IS NULL").count() == 0


def test_rollup(feed, tmp_path, spark):
    df, stream = feed
    aggs = {"n": ("count",), "high": ("max", "value")}
    for _ in ("first", "again"):
        write_rollup(stream(), str(tmp_path / "r"), str(tmp_path / "run"), "1d", ["event_type"], aggs, ts="ts").awaitTermination()
    same(read_rollup(spark, str(tmp_path / "r"), ["event_type"], aggs), windows.tumbling(df, "1d", ["event_type"], aggs, ts="ts"))


def test_rules_are_read_for_each_batch(feed, tmp_path, spark):
    from eventspark.operators.rules import match_rules
    from eventspark.plans.configured import RULES

    df, stream = feed
    rule = lambda limit: spark.createDataFrame(
        [("k", 1, "THRESHOLD", "", f'{{"event_type":"view","field":"k","threshold":{limit}}}', True)], RULES)
    rules = str(tmp_path / "rules")
    rule(50).write.parquet(rules)
    first = stream().filter("event_id < 500")
    run_rules_stream(first, rules, str(tmp_path / "out"), str(tmp_path / "c1"), type_col="event_type", data="props").awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("event_id", "threshold")
    same(found, match_rules(df.filter("event_id < 500"), rule(50), "event_type", "props").select("event_id", "threshold"))
    rule(90).write.mode("overwrite").parquet(rules)
    run_rules_stream(first, rules, str(tmp_path / "out2"), str(tmp_path / "c2"), type_col="event_type", data="props").awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out2")).select("threshold").distinct()
    assert [r[0] for r in found.collect()] == [90.0]
