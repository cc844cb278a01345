"""Admission control: token bucket and fixed windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace
from decimal import ROUND_DOWN, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from eventspark.operators.ordered import ALL, BLOCK, Blocks, Running, attach_small, numbered, prefix, split
from eventspark.session import checkpoint_dir, materialise

# Default admission settings.
RATE, BURST = 1000, 2000


def _scan(rate: float, burst: int, segment_columns: list[str], at: str):
    """Walk sorted rows with one bucket per segment; the state crosses batch borders."""
    whole = 1_000_000
    # A shortfall of under one nanosecond's worth of tokens still passes.
    enough = whole - rate / 1000

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, tokens, last = None, 0.0, 0
        for batch in batches:
            allowed = []
            for now, *here in batch[[at, *segment_columns]].itertuples(index=False, name=None):
                if here != segment:
                    segment, tokens, last = here, burst * whole, now
                tokens = min(burst * whole, tokens + (now - last) * rate)
                last = now
                passes = tokens >= enough
                if passes:
                    tokens -= whole
                allowed.append(passes)
            batch["allowed"] = allowed
            yield batch.drop(columns=[at, *segment_columns])

    return scan


def _segments(df: DataFrame, keys: list[str], rate: float, burst: int, ts: str, id_col: str) -> Blocks:
    """Adds `_segment` (start time and id): stretches of a key that begin with a full bucket.

    The bucket must be full, whatever came before, after a pause of `burst / rate` seconds, and where the
    rows so far, rejected ones counted too, are no more than the tokens earned since some earlier row.
    """
    pause = math.ceil(burst / rate * 1_000_000)
    now = F.unix_micros(ts)
    earlier = {"_before": Running("last", now), "_rows": Running("sum", F.lit(1).cast("long"))}
    rows = prefix(split(df, keys, [ts, id_col]), earlier, inclusive=False)
    # Rows ahead of this one less the tokens earned: a new low means that all are paid back. Decimals are
    # exact, and a rate rounded down only makes fewer cuts.
    per_micro = (Decimal(repr(rate)) / 1_000_000).quantize(Decimal("1e-15"), ROUND_DOWN)
    earned = now.cast("decimal(17,0)") * F.lit(per_micro).cast("decimal(18,15)")
    rows = rows.with_column("_owed", F.coalesce("_rows", F.lit(0)).cast("decimal(28,15)") - earned)
    rows = prefix(rows, {"_lowest": Running("min", F.col("_owed"))})
    starts = F.col("_before").isNull() | (now - F.col("_before") >= pause) | (F.col("_owed") <= F.col("_lowest"))
    place = F.struct(now.alias("us"), F.col(id_col).alias("id"))
    rows = prefix(rows, {"_segment": Running("last", F.when(starts, place))})
    return replace(rows, df=rows.df.drop("_before", "_rows", "_owed", "_lowest"))


def _walked(df: DataFrame, keys: list[str], rate: float, burst: int, ts: str, id_col: str, fields) -> DataFrame:
    """Rows of all segments, each segment walked in order from a full bucket."""
    group = F.to_json(F.struct(*[F.col(k) for k in keys], "_segment"), {"ignoreNullFields": "false"})
    prepared = df.select(*fields.names, F.unix_micros(ts).alias("_at"), group.alias("_group"))
    # The tie-breaking id is part of the order, so a retried task sees the same sequence.
    ordered = prepared.repartition("_group").sortWithinPartitions("_group", ts, id_col)
    schema = StructType([*fields.fields, StructField("allowed", BooleanType())])
    return ordered.mapInPandas(_scan(rate, burst, ["_group"], "_at"), schema)


def _overload(df: DataFrame, keys: list[str], rate: float, burst: int, ts: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Long segments without a walk: (rows decided, with `allowed`; rows left over).

    While the bucket is not full again, row i is let in if the number let in before it is within what
    the burst and the time since the start allow; that number is then i plus a running minimum. Rows
    from the first one that finds the bucket full are left over.
    """
    group = [*keys, "_segment"]
    rows = numbered(split(df, group, [ts, id_col]), "_i")
    gained = F.lit(float(rate)) * (F.unix_micros(ts) - F.col("_segment.us")) / F.lit(1_000_000.0)
    reach = F.floor(F.lit(float(burst)) - 1 + gained + F.lit(rate * 1e-9)).cast("long")
    rows = rows.with_column("_room", reach + 1 - F.col("_i"))
    rows = prefix(rows, {"_least": Running("min", F.col("_room"))}, inclusive=False)
    before = F.col("_i") - 1 + F.least(F.lit(0), F.coalesce("_least", F.lit(0)))
    after = F.col("_i") + F.least(F.lit(0), F.coalesce("_least", F.lit(0)), F.col("_room"))
    decided = rows.df.drop(BLOCK).withColumns(
        {"allowed": after > before, "_full": (F.col("_i") > 1) & (before < gained)}
    )
    decided = materialise(decided)
    # At most one row per long segment.
    place = F.struct(F.unix_micros(ts).alias("us"), F.col(id_col).alias("id"))
    full = decided.filter("_full").groupBy(*group).agg(F.min(place).alias("_until"))
    marked = attach_small(decided, full, group)
    sure = F.col("_until").isNull() | (place < F.col("_until"))
    return marked.filter(sure), marked.filter(~sure).drop("allowed")


def token_bucket(
    df: DataFrame, key: str | None, rate: float = RATE, burst: int = BURST, ts: str = "timestamp", id_col: str = "id"
) -> DataFrame:
    """Adds `allowed`. A bucket per key starts full; rejected rows cost nothing.

    A key is cut into segments that begin with a full bucket. Segments are walked in parallel, rows
    streaming through a task in constant memory. A segment of more rows than a task should take is
    unbroken overload and is decided by running values instead; what follows it, should the bucket fill
    up after all, is cut anew and walked. `key=None` is the one global bucket.
    """
    checkpoint_dir(df.sparkSession)  # asked for whatever the size, not first when a key has grown
    fields = df.schema
    given = df if key else df.withColumn(ALL, F.lit(0))
    keys = [key] if key else [ALL]
    rows = _segments(given, keys, rate, burst, ts, id_col)
    settings = (rate, burst, ts, id_col)
    if not rows.cut:
        return _walked(rows.df, keys, *settings, fields)
    # Used several times below, so it is computed once.
    segmented = materialise(rows.df.drop(BLOCK))
    group = [*keys, "_segment"]
    sizes = segmented.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows.limit).select(*group)
    # No more than total / limit of them.
    long = df.sparkSession.createDataFrame(sizes.collect(), sizes.schema).withColumn("_long", F.lit(True))
    marked = attach_small(segmented, long, group)
    short = _walked(marked.filter("_long IS NULL"), keys, *settings, fields)
    decided, left = _overload(marked.filter("_long"), keys, *settings)
    # A run is what is left of one long segment.
    runs = left.withColumn("_run", F.to_json("_segment")).drop("_segment", "_until", "_full", "_i", "_least", "_room", "_long")
    again = _segments(runs, [*keys, "_run"], *settings)
    walked = _walked(again.df, [*keys, "_run"], *settings, fields)
    return short.unionByName(walked).unionByName(decided.select(*fields.names, "allowed"))


def fixed_window_limit(
    df: DataFrame, key: str, rate: int, ts: str = "timestamp", id_col: str = "id", window: str = "second"
) -> DataFrame:
    """Adds `allowed`: the row is among the first `rate` of its key and second (or other calendar unit)."""
    placed = df.withColumn("_slot", F.date_trunc(window, ts))
    counted = numbered(split(placed, [key, "_slot"], [ts, id_col]), "_rn").result()
    return counted.withColumn("allowed", F.col("_rn") <= rate).drop("_rn", "_slot")
