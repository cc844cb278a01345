"""Sharding by jump consistent hashing: key and shard count decide the shard, and no ring table is kept.

A key's 64-bit hash starts a linear congruential generator that jumps from shard number to shard number; the last jump
below the shard count is the shard. With one more shard about one row in count + 1 moves, each into the new shard.

A row's slot is its place in its shard, from 0 and without gaps, in the order of blocks of keys and within a block of
(key, size, crc32 of the text). A block holds some `BLOCK_ROWS` rows of all shards together, so no shard is numbered
by one task. Equal rows are counted before the shuffle and numbered together: a key that repeats is no hot spot.

A null key is a key of its own, null texts have no bytes. The type of the key is free; its text decides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventspark.llm.frames import free_name, repeated

SHARDS, BLOCK_ROWS = 24, 500_000
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    keys = keys.copy()
    shard, ahead = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    moving = np.arange(len(keys))
    while len(moving):
        shard[moving] = ahead[moving]
        keys[moving] = keys[moving] * _STEP + np.uint64(1)
        spread = float(1 << 31) / ((keys[moving] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[moving] = ((shard[moving] + 1) * spread).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard


def key_hash(key: Column) -> Column:
    """64 bits of the key's text; a null key has its own."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), key.isNull())


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(key_hash(key))


def with_shard(rows: DataFrame, key: str, shards: int = SHARDS) -> tuple[DataFrame, str]:
    """All rows and columns with the shard; returns the new column's name, `shard` unless taken."""
    if shards < 1:
        raise ValueError("at least one shard")
    name = free_name(rows, "shard")
    return rows.withColumn(name, shard_of(F.col(key), shards)), name


def write_shards(rows: DataFrame, key: str, path: str, shards: int = SHARDS) -> None:
    """Write the rows as Parquet, a folder per shard; appended shards need only the rows that move into them."""
    placed, name = with_shard(rows, key, shards)
    placed.write.partitionBy(name).parquet(path)


def shard_digest(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    key = F.col(doc_id)
    rows = documents.select(
        key.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"))
    blocks = max(1, math.ceil(documents.count() / BLOCK_ROWS))
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("rows"))
    key = F.col("doc_id")
    equal = equal.select("*", shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"), F.pmod(key_hash(key), F.lit(blocks)).alias("block"))
    before = Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    inside = equal.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    per_block = equal.groupBy("shard", "block").agg(F.sum("rows").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_block.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = repeated(inside.join(offset, ["shard", "block"]), "rows", "copy")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("first") + F.col("copy")).alias("slot"), "grown_shard")
