"""Streams whose rows come out of order, with a watermark: the results of the batch operators, and state that goes."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from eventspark.operators import admission, patterns, windows
from eventspark.plans.sequences import steps
from eventspark.plans.tables import Tables
from eventspark.streaming import (
    stream_count_windows, stream_match_relaxed, stream_match_strict, stream_threshold, stream_token_bucket,
)
from test_streaming import drain, same

FILES = 4


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Events and streams over them in which rows come up to six days late; a row in 2030 moves the watermark past all."""
    events = Tables(spark, "/root/testdata/sf0.001").events.select("event_id", "event_type", "user_id", "ts").persist()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder = tmp_path_factory.mktemp("shuffled")
    base = folder / "all"
    base.mkdir()
    # A file's rows are of three neighbouring stretches of time.
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    stretch = F.floor((F.unix_micros("ts") - first) * FILES / (last - first + 1))
    file = F.least(F.lit(FILES - 1), stretch + F.when(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, 1).otherwise(0))
    marked = events.withColumn("file", file)
    far = events.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"), F.lit(-1).cast("long").alias("user_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"))
    for k in range(FILES):
        part = marked.filter(F.col("file") == k).drop("file")
        part = part.unionByName(far) if k == FILES - 1 else part
        part.coalesce(1).write.parquet(str(folder / f"part-{k}"))
        target = base / f"{k}.parquet"
        shutil.copy(next((folder / f"part-{k}").glob("*.parquet")), target)
        os.utime(target, (1_700_000_000 + k * 10,) * 2)

    def stream():
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(base))

    yield events, stream
    spark.conf.set("spark.sql.shuffle.partitions", "8")


DELAY = "10d"


def test_strict_match(shuffled, tmp_path):
    events, stream = shuffled
    funnel = steps("view", "click", "purchase")
    batch = patterns.match_strict(events, "user_id", funnel, "96h", ts="ts", id_col="event_id")
    assert batch.count() > 3
    same(drain(stream_match_strict(stream(), "user_id", funnel, "96h", "ts", "event_id", delay=DELAY), tmp_path), batch)


def test_relaxed_match(shuffled, tmp_path):
    events, stream = shuffled
    funnel = steps("view", "click", "purchase")
    batch = patterns.match_relaxed(events, "user_id", funnel, "48h", ts="ts", id_col="event_id")
    same(drain(stream_match_relaxed(stream(), "user_id", funnel, "48h", "ts", "event_id", delay=DELAY), tmp_path), batch)


def test_threshold(shuffled, tmp_path):
    events, stream = shuffled
    error = F.col("event_type") == "error"
    batch = patterns.match_threshold(events, "user_id", error, 3, "48h", ts="ts").select("event_id", "match_count")
    same(drain(stream_threshold(stream(), "user_id", error, 3, "48h", "ts", "event_id", delay=DELAY), tmp_path).select("event_id", "match_count"), batch)


def test_count_windows(shuffled, tmp_path):
    events, stream = shuffled
    batch = windows.count_windows(events, 5, "user_id", ["ts", "event_id"]).filter("complete")
    found = drain(stream_count_windows(stream(), 5, "user_id", "ts", "event_id", delay=DELAY), tmp_path)
    same(found.select("user_id", "window_index", "event_count", "complete"), batch)


def test_token_bucket(shuffled, tmp_path):
    events, stream = shuffled
    batch = admission.token_bucket(events, "user_id", 0.00002, 2, "ts", "event_id").select("event_id", "allowed")
    found = drain(stream_token_bucket(stream(), "user_id", 0.00002, 2, "ts", "event_id", delay=DELAY), tmp_path)
    same(found.filter("event_id >= 0").select("event_id", "allowed"), batch)


def test_state_of_idle_keys_goes(spark, shuffled, tmp_path):
    events, _ = shuffled
    source = tmp_path / "in"
    row = lambda k, at: events.limit(1).select(F.lit(k).cast("long").alias("event_id"), F.lit("end").alias("event_type"), F.lit(-k).cast("long").alias("user_id"), F.lit(at).cast("timestamp").alias("ts"))
    events.unionByName(row(-1, "2030-01-01")).coalesce(1).write.parquet(str(source))

    def held():
        stream = spark.readStream.schema(events.schema).parquet(str(source))
        drain(stream_match_strict(stream, "user_id", steps("view", "click", "purchase"), "96h", "ts", "event_id", delay=DELAY), tmp_path)
        read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "out" / "ckpt"))
        return read("recent").count(), read("last").count()

    keys = events.select("user_id").distinct().count()
    assert keys > 10 and held() == (keys, keys)  # rows were handed on, their timers come next
    row(-2, "2031-01-01").coalesce(1).write.mode("append").parquet(str(source))
    assert max(held()) <= 1  # but for the row in 2030
