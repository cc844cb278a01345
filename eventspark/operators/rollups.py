"""Rollups whose stored rows can be merged again: counts, sums, extremes, means, deviations, percentiles, distinct counts.

An aggregate is stored as one or more partial columns:

    count, sum, min, max   the value itself, under the aggregate's own name
    avg                    `<name>__n`, `<name>__sum`
    stddev                 `<name>__n`, `<name>__sum`, `<name>__squares` (sum of squares)
    percentile             `<name>__kll`, a KLL sketch of doubles
    distinct               `<name>__hll`, a HyperLogLog sketch of the values' text

Errors: a percentile's rank is within `KLL_RANK_ERROR` of the wanted one (99 % of the time; a group of at most KLL_K
values is exact up to its nearest rank); a distinct count has a relative standard error of `HLL_ERROR`. Deviations come
from sums of squares, so the digits of (mean / deviation) squared are lost of a double's sixteen; use decimals where
that matters. Sketches have a bounded size whatever the group, and partial aggregation builds them before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.clock import interval_text

Aggs = dict[str, tuple]

KLL_K, HLL_LG = 800, 14
KLL_RANK_ERROR, HLL_ERROR = 0.004, 0.0082

PLAIN = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
KINDS = (*PLAIN, "avg", "stddev", "percentile", "distinct")


def _check(aggs: Aggs) -> None:
    wrong = sorted({spec[0] for spec in aggs.values()} - set(KINDS))
    if wrong:
        raise ValueError(f"a maintained rollup has no {', '.join(wrong)}; it takes {', '.join(KINDS)}")


def partial_columns(aggs: Aggs) -> list[Column]:
    """The partial columns, as aggregates of rows."""
    _check(aggs)
    out: list[Column] = []
    for name, (kind, *args) in aggs.items():
        column = F.col(args[0]) if args and isinstance(args[0], str) else args[0] if args else F.lit(1)
        if kind == "count":
            out.append(F.count(column).alias(name))
        elif kind in PLAIN:
            out.append(PLAIN[kind](column).alias(name))
        elif kind == "percentile":
            out.append(F.kll_sketch_agg_double(column.cast("double"), KLL_K).alias(f"{name}__kll"))
        elif kind == "distinct":
            out.append(F.hll_sketch_agg(column.cast("string"), HLL_LG).alias(f"{name}__hll"))
        else:
            out += [F.count(column).alias(f"{name}__n"), F.sum(column).alias(f"{name}__sum")]
            if kind == "stddev":
                out.append(F.sum(column * column).alias(f"{name}__squares"))
    return out


def merge_columns(aggs: Aggs) -> list[Column]:
    """The partial columns again, as aggregates of partial columns."""
    _check(aggs)
    out: list[Column] = []
    for name, (kind, *_) in aggs.items():
        if kind in PLAIN:
            out.append(PLAIN[kind](name).alias(name))
        elif kind == "percentile":
            out.append(F.kll_merge_agg_double(f"{name}__kll", KLL_K).alias(f"{name}__kll"))
        elif kind == "distinct":
            out.append(F.hll_union_agg(f"{name}__hll").alias(f"{name}__hll"))
        else:
            parts = ["n", "sum", *["squares"] * (kind == "stddev")]
            out += [F.sum(f"{name}__{part}").alias(f"{name}__{part}") for part in parts]
    return out


def final_columns(aggs: Aggs) -> list[Column]:
    """The aggregates' values from partial columns."""
    _check(aggs)
    out: list[Column] = []
    for name, (kind, *args) in aggs.items():
        part = lambda p, name=name: F.col(f"{name}__{p}")
        if kind in PLAIN:
            value = F.col(name)
        elif kind == "percentile":
            some = F.kll_sketch_get_n_double(part("kll")) > 0
            value = F.when(some, F.kll_sketch_get_quantile_double(part("kll"), F.lit(float(args[1]))))
        elif kind == "distinct":
            value = F.hll_sketch_estimate(part("hll"))
        else:
            n, total = part("n"), part("sum")
            value = F.when(n > 0, total / n)
            if kind == "stddev":
                spread = (part("squares").cast("double") - total.cast("double") * total.cast("double") / n) / (n - 1)
                value = F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0))))
        out.append(value.alias(name))
    return out


def partial_rollup(df: DataFrame, size: str, keys: list[str], aggs: Aggs, ts: str = "timestamp") -> DataFrame:
    """window_start, window_end, the keys and the partial columns of tumbling windows."""
    rows = df.groupBy(F.window(ts, interval_text(size)), *keys).agg(*partial_columns(aggs))
    rest = [c for c in rows.columns if c != "window"]
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def merge_rollup(rows: DataFrame, keys: list[str], aggs: Aggs) -> DataFrame:
    """Partial rows of the same window and keys as one."""
    return rows.groupBy("window_start", "window_end", *keys).agg(*merge_columns(aggs))


def maintain_rollup(new: DataFrame, rollup: DataFrame, size: str, keys: list[str], aggs: Aggs, ts: str = "timestamp") -> DataFrame:
    """The rollup after new rows: their partial aggregates merged into the stored ones."""
    return merge_rollup(rollup.unionByName(partial_rollup(new, size, keys, aggs, ts)), keys, aggs)


def coarsen(rollup: DataFrame, size: str, keys: list[str], aggs: Aggs) -> DataFrame:
    """A rollup of larger windows (whole numbers of the stored ones) or fewer keys, from stored rows alone."""
    rows = rollup.withColumn("_w", F.window("window_start", interval_text(size)))
    rows = rows.withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")})
    return merge_rollup(rows, keys, aggs)


def rollup_values(rollup: DataFrame, keys: list[str], aggs: Aggs) -> DataFrame:
    """window_start, window_end, the keys and the aggregates' values."""
    return rollup.select("window_start", "window_end", *keys, *final_columns(aggs))
