"""Which of the arriving ids may be stored already: a Bloom filter per month, beside a month-partitioned table.

The filter lies in `<path>/_ids`, which readers of the table don't see. It is made of blocks of 32,768 bits; an id's hash
picks its block and `PROBES` bits in it, so a filter grows with its ids, in Spark, and no part of it is larger than a
block. With ten bits an id (`BLOCKS_CONF` x 3,276 ids a month) one new id in a hundred is looked up in vain; beyond
that more are, and nothing is missed: `rebuild` makes the filter anew with more blocks.

An append writes the bits of its ids before its rows: a failure between the two leaves bits without rows, which costs a
lookup. Every append's bits are a folder of their own; `compact_ids` merges them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.operators.sizes import is_small
from eventspark.sources.history import MONTH
from eventspark.operators.compaction import BATCH, Folder, batches, compact, manifest, read_live

BITS, PROBES = 32_768, 6
BLOCKS_CONF, DEFAULT_BLOCKS = "eventspark.idBlocks", 1024
IDS = "_ids"


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("event_id"), blocks).cast("int")


def _bits() -> Column:
    """The bits of an id in its block."""
    first, stride = F.xxhash64("event_id", F.lit(1)), F.xxhash64("event_id", F.lit(2))
    return F.array(*[F.pmod(F.pmod(first, F.lit(BITS)) + k * F.pmod(stride, F.lit(BITS)), F.lit(BITS)) for k in range(PROBES)])


def filter_rows(ids: DataFrame, blocks: int) -> DataFrame:
    """(month, blocks, block, bitmap) of (event_id, month) rows."""
    bits = ids.select(MONTH, F.lit(blocks).alias("blocks"), _block(F.lit(blocks)).alias("block"), F.explode(_bits()).alias("bit"))
    return bits.groupBy(MONTH, "blocks", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def has_filter(spark: SparkSession, path: str) -> bool:
    folder = Folder(spark, f"{path.rstrip('/')}/{IDS}")
    return bool(batches(folder) or manifest(folder).folders)


def add_ids(ids: DataFrame, path: str) -> None:
    """Set the bits of (event_id, month) rows."""
    blocks = int(ids.sparkSession.conf.get(BLOCKS_CONF, str(DEFAULT_BLOCKS)))
    filter_rows(ids, blocks).write.parquet(f"{path.rstrip('/')}/{IDS}/{BATCH}={uuid.uuid4().hex}_0")


def rebuild(stored: DataFrame, path: str, blocks: int) -> None:
    """Make the filter anew from the table's rows, with so many blocks a month; no append may run meanwhile."""
    spark = stored.sparkSession
    folder = Folder(spark, f"{path.rstrip('/')}/{IDS}")
    filter_rows(stored.select("event_id", MONTH), blocks).write.parquet(f"{folder.path}/new")
    for name in folder.names():
        if name != "new":
            folder.remove(name)
    folder.fs.rename(folder.at("new"), folder.at(f"{BATCH}={uuid.uuid4().hex}_0"))


def compact_ids(spark: SparkSession, path: str, **options) -> int:
    """Merge the folders of many appends; the bits stay the same. No append may run meanwhile."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(MONTH, "blocks", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    return compact(spark, f"{path.rstrip('/')}/{IDS}", merge, settled=True, **options)


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1


def in_months(months: list[str | None]) -> Column:
    """Rows of these months; None is the month of rows without a time."""
    named = F.col(MONTH).isin([m for m in months if m is not None])
    return named | F.col(MONTH).isNull() if None in months else named


def maybe_stored(ids: DataFrame, path: str, months: list[str | None] | None = None) -> DataFrame:
    """Distinct (month, event_id) of ids (`event_id`) that may be in that month of the table; all others are new."""
    spark = ids.sparkSession
    known = read_live(spark, f"{path.rstrip('/')}/{IDS}")
    if months is not None:
        known = known.filter(in_months(months))
    sizes = [r[0] for r in known.select("blocks").distinct().collect()]  # a few, one per setting used so far
    wanted = ids.select("event_id", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("blocks")) if sizes else ids.select("event_id", F.lit(0).alias("blocks"))
    wanted = wanted.select("event_id", "blocks", _block(F.greatest("blocks", F.lit(1))).alias("block"), _bits().alias("bits"))
    if is_small(ids.select("event_id")):
        wanted = F.broadcast(wanted)
    met = known.join(wanted, ["blocks", "block"])
    return met.filter(F.forall("bits", lambda bit: _is_set(F.col("bitmap"), bit))).select(MONTH, "event_id").distinct()
