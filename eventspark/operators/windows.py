"""Time, session and count windows, late rows, deduplication and rollups.

The windowed aggregations run on batches and streams alike. Where Spark's batch form would put a
whole key into one task (sessions, counts, arrival order) the batch form uses the ordered core.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.clock import elapsed_ms, interval_text, micros
from eventspark.operators import rollups
from eventspark.operators.ordered import Running, numbered, prefix, split

# name -> (kind, column); kinds as in `aggregate_column`.
Aggs = dict[str, tuple]

MERGEABLE = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}


def aggregate_column(kind: str, column: str | Column | None = None, *args) -> Column:
    """count, sum, avg, min, max, stddev, or percentile (exact, with a fraction; see `_percentile` for its batch form)."""
    if kind == "count":
        return F.count(F.lit(1) if column is None else column)
    if kind == "percentile":
        return F.percentile(column, *args)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp}[kind](column)


def _columns(aggs: Aggs) -> list[Column]:
    return [aggregate_column(*spec).alias(name) for name, spec in aggs.items()]


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def _percentile(df: DataFrame, keys: list[str], name: str, column: str, fraction: float) -> DataFrame:
    """Keys and an exact percentile, interpolated between neighbours.

    Equal values are counted first; running counts by value, cut into blocks for a hot key, then tell which values
    hold the two ranks, so no task keeps a group's values.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    upto = prefix(split(counted, keys, ["_value"]), {"_upto": Running("sum", F.col("_n"))}).result()
    totals = counted.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_n").alias("_total"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    at = (F.col("_total") - 1) * F.lit(float(fraction))

    def value_of(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_value")))

    ranks = upto.join(totals, same).withColumns({"_at": at, "_low": F.floor(at), "_high": F.ceil(at)})
    found = ranks.groupBy(*keys).agg(
        value_of(F.col("_low")).alias("_below"), value_of(F.col("_high")).alias("_above"), F.first("_at").alias("_at"), F.first("_low").alias("_low"))
    part = F.col("_at") - F.col("_low")
    return found.select(*keys, (F.col("_below") * (1 - part) + F.col("_above") * part).alias(name))


def _by_keys(df: DataFrame, keys: list[str], aggs: Aggs) -> DataFrame:
    """Aggregates by columns; on a batch with keys the exact percentiles go by ranks, each joined by the keys."""
    ranked = {name: spec for name, spec in aggs.items() if spec[0] == "percentile" and keys and not df.isStreaming}
    rest = {name: spec for name, spec in aggs.items() if name not in ranked}
    result = df.groupBy(*keys).agg(*(_columns(rest) or [F.count(F.lit(1)).alias("_rows")]))
    for name, (_, column, fraction) in ranked.items():
        other = _percentile(df, keys, name, column, fraction).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        result = result.join(other, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return result.select(*keys, *aggs)


def aggregate(df: DataFrame, keys: list[str], aggs: Aggs, window: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Aggregates by keys and, if given, a tumbling window."""
    if window:
        return tumbling(df, window, keys, aggs, ts)
    return _by_keys(df, keys, aggs)


def tumbling(df: DataFrame, size: str, keys: list[str], aggs: Aggs, ts: str = "timestamp") -> DataFrame:
    """Windows `[start, end)`."""
    if df.isStreaming or all(spec[0] != "percentile" for spec in aggs.values()):
        return _flat(df.groupBy(F.window(ts, interval_text(size)), *keys).agg(*_columns(aggs)))
    placed = df.withColumn("_window", F.window(ts, interval_text(size)))
    placed = placed.withColumns({"window_start": F.col("_window.start"), "window_end": F.col("_window.end")}).drop("_window")
    return _by_keys(placed, ["window_start", "window_end", *keys], aggs)


def sliding(df: DataFrame, size: str, slide: str, keys: list[str], aggs: Aggs, ts: str = "timestamp") -> DataFrame:
    """Overlapping windows.

    Mergeable aggregates over whole numbers of slides are first reduced to one row per slide, so a row
    is not copied into each of its windows before aggregation. (A stream copies: one aggregation only.)
    """
    whole = micros(size) % micros(slide) == 0
    if df.isStreaming or not whole or any(spec[0] not in MERGEABLE for spec in aggs.values()):
        window = F.window(ts, interval_text(size), interval_text(slide))
        return _flat(df.groupBy(window, *keys).agg(*_columns(aggs)))
    panes = tumbling(df, slide, keys, aggs, ts)
    again = {name: (MERGEABLE[spec[0]], name) for name, spec in aggs.items()}
    return _flat(
        panes.groupBy(F.window("window_start", interval_text(size), interval_text(slide)), *keys).agg(*_columns(again))
    )


def sessions(
    df: DataFrame, gap: str, key: str, aggs: Aggs | None = None, ts: str = "timestamp", tie: str | None = None
) -> DataFrame:
    """Sessions per key: an event `gap` or more after the previous one starts a new session.

    `session_end` is the last event's time plus the gap. `tie` names a row id that lets rows of equal time be split.
    """
    aggs = aggs or {"event_count": ("count",)}
    if df.isStreaming:
        grouped = df.groupBy(F.session_window(ts, interval_text(gap)).alias("window"), key).agg(*_columns(aggs))
        return _flat(grouped).withColumnsRenamed({"window_start": "session_start", "window_end": "session_end"})
    width = micros(gap)
    order = [ts] if tie is None else [ts, tie]
    rows = prefix(split(df, [key], order), {"_before": Running("last", F.col(ts))}, inclusive=False)
    starts = F.col("_before").isNull() | (F.unix_micros(ts) - F.unix_micros("_before") >= width)
    rows = prefix(rows, {"session_start": Running("last", F.when(starts, F.col(ts)))})
    grouped = rows.result().groupBy(key, "session_start").agg(F.max(ts).alias("_end"), *_columns(aggs))
    end = F.timestamp_micros(F.unix_micros("_end") + width)
    return grouped.select("session_start", end.alias("session_end"), key, *aggs)


def count_windows(
    df: DataFrame, n: int, key: str, order: list[str], aggs: Aggs | None = None
) -> DataFrame:
    """Windows of `n` consecutive events per key; the last one may be incomplete."""
    aggs = aggs or {}
    rows = numbered(split(df, [key], order), "_rn").result()
    window = F.floor((F.col("_rn") - 1) / n).cast("long")
    grouped = rows.withColumn("window_index", window).groupBy(key, "window_index").agg(
        F.count(F.lit(1)).alias("event_count"), *_columns(aggs)
    )
    return grouped.withColumn("complete", F.col("event_count") == n)


def with_watermark(df: DataFrame, delay: str, ts: str = "timestamp") -> DataFrame:
    return df.withWatermark(ts, interval_text(delay))


def lateness(df: DataFrame, key: str, arrival: list[str], ts: str = "timestamp") -> DataFrame:
    """Adds `max_seen`, the latest event time that arrived before the row for its key, and `lateness_ms`."""
    rows = prefix(split(df, [key], arrival), {"max_seen": Running("max", F.col(ts))}, inclusive=False).result()
    behind = elapsed_ms(F.col(ts), F.col("max_seen"))
    return rows.withColumn("lateness_ms", F.coalesce(F.greatest(behind, F.lit(0)), F.lit(0)))


def mark_late(df: DataFrame, key: str, delay: str, arrival: list[str], ts: str = "timestamp") -> DataFrame:
    """Adds `is_late`: the event time is more than `delay` behind what arrived before for the key."""
    rows = lateness(df, key, arrival, ts)
    late = F.unix_micros(ts) < F.unix_micros("max_seen") - micros(delay)
    return rows.withColumn("is_late", F.coalesce(late, F.lit(False))).drop("lateness_ms")


def split_late(
    df: DataFrame, key: str, delay: str, arrival: list[str], ts: str = "timestamp"
) -> tuple[DataFrame, DataFrame]:
    """(on time, late)."""
    marked = mark_late(df, key, delay, arrival, ts)
    return marked.filter(~F.col("is_late")), marked.filter("is_late")


def dedupe(df: DataFrame, id_col: str, arrival: list[str] | None = None, ts: str = "timestamp", within: str | None = None) -> DataFrame:
    """One row per id: the first to arrive. On a stream, within the watermark `within`."""
    if df.isStreaming:
        return df.withWatermark(ts, interval_text(within)).dropDuplicatesWithinWatermark([id_col])
    row = F.struct(*[F.col(c) for c in df.columns])
    first = F.min_by(row, F.struct(*[F.col(c) for c in arrival]))
    return df.groupBy(id_col).agg(first.alias("_row")).select("_row.*")


def user_activity(df: DataFrame, size: str = "1h", user: str = "userId", ts: str = "ts") -> DataFrame:
    """Events per user and window."""
    return tumbling(df, size, [user], {"activity_count": ("count",)}, ts)


def tenant_usage(df: DataFrame, size: str = "1d", ts: str = "timestamp") -> DataFrame:
    """Events and distinct types per tenant and window; rows without a tenant form their own group."""
    counted = df.groupBy(F.window(ts, interval_text(size)), "tenant_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct("type").alias("type_count")
    )
    return _flat(counted)


# Rollups that can be maintained (see `rollups`); a batch and a stream's micro-batch alike.
partial_rollup, maintain_rollup = rollups.partial_rollup, rollups.maintain_rollup


def latest_state(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of every entity."""
    row = F.struct(*[F.col(c) for c in df.columns])
    last = F.max_by(row, F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(last.alias("_row")).select("_row.*")
