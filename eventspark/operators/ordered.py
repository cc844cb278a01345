"""Ordered, per-key computations that do not break when one key holds a large share of the rows.

A plain window puts a whole key into one task. Here a key above a row limit is first cut into
ordered blocks: the hot keys are found with one partially aggregated count, the cut points come from
a bounded sample (they only balance the load; results never depend on them) and each row of a hot
key finds its block by binary search in a broadcast list of cut points. Work then runs per
(key, block) and blocks are stitched together through one small row per block:

* `prefix`   running sum / count / min / max / last-non-null over all earlier rows of the key
* `halo`     copies of the neighbouring rows a bounded row frame needs (lag, lead, moving averages)
* `trailing` sums over a trailing time range, in linear time

Keys below the limit keep block null, so data without hot keys runs as one ordinary window.
Everything broadcast or brought to the driver is bounded by the number of blocks (`maxBlocks`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT_CONF = "eventspark.rowsPerGroup"
BLOCKS_CONF = "eventspark.maxBlocks"
DEFAULT_LIMIT = 10_000_000
SAMPLES_PER_BLOCK = 32

BLOCK = "_block"
ALL = "_all"
HALO = "_halo"


@dataclass(frozen=True)
class Blocks:
    """Rows with their block, the keys and order they were cut by, and whether any key was cut."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    cut: bool
    limit: int = DEFAULT_LIMIT

    @property
    def group(self) -> list[str]:
        return [*self.keys, BLOCK] if self.cut else self.keys

    def window(self, *, reverse: bool = False):
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.group).orderBy(*order)

    def hot(self) -> DataFrame:
        return self.df.filter(F.col(BLOCK).isNotNull())

    def with_column(self, name: str, value: Column) -> Blocks:
        return replace(self, df=self.df.withColumn(name, value))

    def result(self, *drop: str) -> DataFrame:
        return self.df.drop(BLOCK, ALL, *drop)


def attach_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Broadcast join (null keys match) with a table bounded by the number of blocks."""
    renamed = small.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
                           *[c for c in small.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)])
    return df.join(F.broadcast(renamed), on, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def split(df: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> Blocks:
    """Cut the keys holding more than `limit` rows into blocks along `order`.

    `order` names plain columns, ascending, that should identify a row within its key; equal rows are
    never separated. `limit` defaults to the session setting `eventspark.rowsPerGroup`.
    """
    spark = df.sparkSession
    if limit is None:
        limit = int(spark.conf.get(LIMIT_CONF, str(DEFAULT_LIMIT)))
    default_blocks = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    max_blocks = int(spark.conf.get(BLOCKS_CONF, str(default_blocks)))

    if not keys:
        keys = [ALL]
        df = df.withColumn(ALL, F.lit(0))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    limit = max(limit, math.ceil((total or 0) / max_blocks))
    if (largest or 0) <= limit:
        return Blocks(df.withColumn(BLOCK, F.lit(None).cast("int")), keys, order, False, limit)

    # At most total / limit keys, hence at most max_blocks rows.
    hot = sizes.filter(F.col("_n") > limit)
    hot = spark.createDataFrame(hot.collect(), hot.schema)
    rows = hot.agg(F.sum("_n")).first()[0]
    fraction = min(1.0, SAMPLES_PER_BLOCK * rows / limit / rows)
    stride = max(1, int(limit * fraction * 0.75))
    point = F.struct(*[F.col(c) for c in order])
    sample = attach_small(df.select(*keys, *[c for c in order if c not in keys]).sample(fraction, seed=7),
                          hot, keys, "inner")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cuts = (
        sample.withColumn("_place", place)
        .filter(F.col("_place") % stride == 0)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set(point)).alias("_cuts"))
    )
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)
    size = F.size("_cuts")
    widest = cuts.agg(F.max(size)).first()[0] or 0
    steps = max(1, widest.bit_length())
    found = F.aggregate(
        F.array(*[F.lit(2**s) for s in reversed(range(steps))]),
        F.lit(0),
        lambda low, jump: F.when(
            (low + jump <= size) & (F.get("_cuts", low + jump - 1) <= point), low + jump
        ).otherwise(low),
    )
    df = attach_small(df, cuts, keys).withColumn(BLOCK, F.when(F.col("_cuts").isNotNull(), found)).drop("_cuts")
    return Blocks(df, keys, order, True, limit)


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is sum, min, max or last (last non-null)."""

    kind: str
    value: Column

    def local(self, frame) -> Column:
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(frame)
        return getattr(F, self.kind)(self.value).over(frame)

    def of_block(self, point: Column, reverse: bool) -> Column:
        if self.kind == "last":
            pick = F.min_by if reverse else F.max_by
            return pick(self.value, F.when(self.value.isNotNull(), point))
        return getattr(F, self.kind)(self.value)

    def over_blocks(self, name: str, frame) -> Column:
        if self.kind == "last":
            return F.last(name, ignorenulls=True).over(frame)
        return getattr(F, self.kind)(name).over(frame)

    def combine(self, local: Column, carried: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(local, carried)
        if self.kind == "sum":
            return F.coalesce(local + carried, local, carried)
        return F.greatest(local, carried) if self.kind == "max" else F.least(local, carried)


def prefix(
    blocks: Blocks,
    values: dict[str, Running],
    *,
    inclusive: bool = True,
    reverse: bool = False,
    by_range: bool = False,
) -> Blocks:
    """Add running values over all earlier rows (`reverse`: later rows) of the key.

    `by_range` counts rows with an equal order value as earlier too (one numeric order column).
    """
    frame = blocks.window(reverse=reverse)
    bounds = frame.rangeBetween if by_range else frame.rowsBetween
    frame = bounds(Window.unboundedPreceding, 0 if inclusive else -1)
    if not blocks.cut:
        return replace(blocks, df=blocks.df.withColumns({n: r.local(frame) for n, r in values.items()}))

    point = F.struct(*[F.col(c) for c in blocks.order])
    totals = blocks.hot().groupBy(*blocks.group).agg(
        *[r.of_block(point, reverse).alias(n) for n, r in values.items()]
    )
    along = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    earlier = Window.partitionBy(*blocks.keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *blocks.group, *[r.over_blocks(n, earlier).alias(f"_carry_{n}") for n, r in values.items()]
    )
    df = blocks.df.withColumns({n: r.local(frame) for n, r in values.items()})
    df = attach_small(df, carried, blocks.group)
    df = df.withColumns({n: r.combine(F.col(n), F.col(f"_carry_{n}")) for n, r in values.items()})
    return replace(blocks, df=df.drop(*[f"_carry_{n}" for n in values]))


def numbered(blocks: Blocks, name: str) -> Blocks:
    """Row number within the key, from 1."""
    return prefix(blocks, {name: Running("sum", F.lit(1).cast("long"))})


def halo(blocks: Blocks, before: int = 0, after: int = 0) -> Blocks:
    """Add to every block copies (flag `_halo`) of the `before` rows ahead of it and the `after` rows behind.

    Row frames of that size over `window()` are then exact; filter the flag out afterwards.
    """
    marked = blocks.with_column(HALO, F.lit(False))
    if not blocks.cut:
        return marked
    sizes = blocks.hot().groupBy(*blocks.group).agg(F.count(F.lit(1)).alias("_n"))
    by_block = Window.partitionBy(*blocks.keys).orderBy(BLOCK)
    sizes = sizes.select(
        *blocks.group, "_n",
        F.row_number().over(by_block).alias("_i"),
        F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
    )
    source = sizes.select(*blocks.group, "_i", "_upto", "_n")
    target = sizes.select(
        *blocks.keys, F.col("_i").alias("_to"), F.col(BLOCK).alias("_to_block"),
        F.col("_upto").alias("_to_upto"), F.col("_n").alias("_to_n"),
    )
    parts = [marked.df]
    for width, backwards in ((before, True), (after, False)):
        if not width:
            continue
        rank = F.row_number().over(blocks.window(reverse=backwards))
        edge = marked.df.filter(F.col(BLOCK).isNotNull()).withColumn("_rank", rank).filter(F.col("_rank") <= width)
        edge = attach_small(edge, source, blocks.group, "inner")
        step = 1 if backwards else -1
        edge = edge.withColumn("_to", F.explode(F.sequence(F.col("_i") + step, F.col("_i") + step * width)))
        edge = attach_small(edge, target, [*blocks.keys, "_to"], "inner")
        if backwards:
            between = F.col("_to_upto") - F.col("_to_n") - F.col("_upto")
        else:
            between = (F.col("_upto") - F.col("_n")) - F.col("_to_upto")
        edge = edge.filter(F.col("_rank") + between <= width)
        parts.append(edge.withColumns({BLOCK: F.col("_to_block"), HALO: F.lit(True)}).select(*marked.df.columns))
    return replace(marked, df=reduce(DataFrame.unionByName, parts))


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, BLOCK, ALL)


def trailing(
    df: DataFrame,
    keys: list[str],
    ts: str,
    within: int,
    values: dict[str, Column],
    *,
    include_current: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Add sums of `values` over the rows of the key in the last `within` microseconds.

    The range is `[ts - within, ts]`, or `[ts - within, ts)` without the current instant. Each row
    enters once and leaves once, so a wide range costs no more than a narrow one. Values are summed
    and taken out again: use integers or decimals.
    """
    columns = df.columns
    at = F.unix_micros(ts) * 2
    base = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    # Even positions: rows entering; odd positions: rows leaving, just after the last instant they count for.
    enter = base.withColumns({"_pos": at, "_leaves": F.lit(False)})
    leave = base.select(
        *keys, *[(-F.col(f"_v_{n}")).alias(f"_v_{n}") for n in values],
        (at + (2 * within + 1)).alias("_pos"), F.lit(True).alias("_leaves"),
    )
    moves = enter.unionByName(leave, allowMissingColumns=True)
    blocks = split(moves, keys, ["_pos"], limit)
    summed = prefix(
        blocks, {n: Running("sum", F.col(f"_v_{n}")) for n in values}, inclusive=include_current, by_range=True
    )
    kept = summed.df.filter(~F.col("_leaves"))
    return kept.select(*columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in values])
