"""Enrichment, time-windowed joins, traces and type correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.clock import elapsed_ms, interval_text, micros
from eventspark.operators.ordered import Running, numbered, prefix, split, trailing
from eventspark.operators.sizes import join_lookup

def enrich(events: DataFrame, dim: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """Events with the columns of a static table; no event is dropped."""
    return join_lookup(events, dim, on, "left")


def interval_join(
    a: DataFrame, b: DataFrame, on: str, within: str, how: str = "inner", a_ts: str = "a_ts", b_ts: str = "b_ts"
) -> DataFrame:
    """Pairs of equal key with `b_ts` in `(a_ts, a_ts + within]`; apart from the key, names must differ.

    Batch: time is cut into bins of that width, so a hot key is spread over its bins. A b-row is put into its own bin
    and the one before, in which any a-row stands that it can pair with; an a-row stands in one bin, so a left join is
    one join. Stream: both sides need watermarks.
    """
    width = micros(within)
    if a.isStreaming or b.isStreaming:
        right = b.withColumnRenamed(on, "_on")
        close = (F.col(b_ts) > F.col(a_ts)) & (F.col(b_ts) <= F.col(a_ts) + F.expr(f"INTERVAL {interval_text(within)}"))
        return a.join(right, (F.col(on) == F.col("_on")) & close, how).drop("_on")
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    close = (F.unix_micros(b_ts) > F.unix_micros(a_ts)) & (F.unix_micros(b_ts) - F.unix_micros(a_ts) <= width)
    bin_of = lambda ts: F.floor(F.unix_micros(ts) / F.lit(width))
    right = b.withColumnRenamed(on, "_on").withColumn("_bin", F.explode(F.array(bin_of(b_ts), bin_of(b_ts) - 1)))
    meets = (F.col(on) == F.col("_on")) & (F.col("_a_bin") == F.col("_bin")) & close
    return a.withColumn("_a_bin", bin_of(a_ts)).join(right, meets, how).drop("_a_bin", "_bin", "_on")


def trace_summary(df: DataFrame, key: str = "correlation_id", ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    """One row per trace: root and last event, size and span."""
    point = F.struct(ts, id_col)
    summary = df.groupBy(key).agg(
        F.min_by(id_col, point).alias("root_id"),
        F.max_by(id_col, point).alias("last_id"),
        F.count(F.lit(1)).alias("event_count"),
        F.min(ts).alias("started_at"),
        F.max(ts).alias("ended_at"),
    )
    return summary.withColumn("span_ms", elapsed_ms(F.col("started_at"), F.col("ended_at")))


def correlate(df: DataFrame, key: str = "correlation_id", ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    """Events with their place in the trace: `position` from 1, `root_id`, and time since the root.

    A trace stays rows, never one array, so its size does not matter.
    """
    rows = numbered(split(df, [key], [ts, id_col]), "position")
    first = F.struct(F.col(ts).alias("ts"), F.col(id_col).alias("id"))
    rows = prefix(rows, {"_root": Running("min", first)})
    return rows.result().withColumns(
        {"root_id": F.col("_root.id"), "since_root_ms": elapsed_ms(F.col("_root.ts"), F.col(ts))}
    ).drop("_root")


def type_correlation(df: DataFrame, key: str, within: str, ts: str = "timestamp", type_col: str = "type") -> DataFrame:
    """Ordered type pairs: how often b follows a within `within` (later, same key).

    `support` is pairs per event, `confidence` pairs per a-event, `lift` confidence over b's share.
    Pairs are counted, not made: each event adds the trailing number of events of every type that its key has in the
    event's bin of time or the one before (bins are as wide as `within`); other types can't have any. Types stay data:
    however many there are, none is brought to the driver, and a hot key is spread over its bins.
    """
    width = micros(within)
    slim = df.filter(F.col(type_col).isNotNull()).select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(type_col).alias("_type"))
    totals = slim.groupBy(F.col("_type").alias(type_col)).agg(F.count(F.lit(1)).alias("n"))
    binned = slim.filter(F.col("_ts").isNotNull()).withColumn("_bin", F.floor(F.unix_micros("_ts") / F.lit(width)))
    near = binned.select("_key", F.explode(F.array(F.col("_bin"), F.col("_bin") + 1)).alias("_near"), F.col("_type").alias("_a")).distinct()
    # Rows of equal key, type and time ask and count together.
    each = binned.groupBy("_key", "_ts", "_bin", "_type").agg(F.count(F.lit(1)).alias("_n"))
    on = near.withColumnRenamed("_key", "_near_key")
    asks = each.join(on, F.col("_key").eqNullSafe(F.col("_near_key")) & (F.col("_bin") == F.col("_near"))).select(
        "_key", "_ts", "_a", F.col("_type").alias("_b"), F.col("_n").alias("_times"), F.lit(0).cast("long").alias("_one"))
    events = each.select("_key", "_ts", F.col("_type").alias("_a"), F.lit(None).cast("string").alias("_b"), F.lit(0).cast("long").alias("_times"), F.col("_n").alias("_one"))
    both = asks.withColumn("_b", F.col("_b").cast("string")).unionByName(events)
    counted = trailing(both, ["_key", "_a"], "_ts", width, {"_before": F.col("_one")}, include_current=False)
    found = counted.filter("_times > 0").groupBy(F.col("_a").alias("type_a"), F.col("_b").cast(df.schema[type_col].dataType).alias("type_b")).agg(
        F.sum(F.col("_before") * F.col("_times")).alias("pairs")).filter(F.col("pairs") > 0)
    of_a = totals.select(F.col(type_col).alias("type_a"), F.col("n").alias("n_a"))
    of_b = totals.select(F.col(type_col).alias("type_b"), F.col("n").alias("n_b"))
    whole = slim.count()
    return (
        found.join(of_a, "type_a").join(of_b, "type_b")
        .withColumns({
            "support": F.col("pairs") / F.lit(whole),
            "confidence": F.col("pairs") / F.col("n_a"),
            "lift": F.col("pairs") * F.lit(float(whole)) / (F.col("n_a") * F.col("n_b")),
        })
        .select("type_a", "type_b", "pairs", "support", "confidence", "lift")
    )
