"""Benchmark decontamination: a broadcast hash set of test n-grams, a scan of all text windows, verified hits.

A benchmark item's windows are its runs of `window` words; an item of fewer words, but not none, is one window. The
windows go to every task as a set of 64-bit hashes with the words themselves, at most `BLOCK_WINDOWS` at a time: a
larger benchmark is scanned in several blocks, one after the other over the same rows. A document window whose hash
is in the set is compared word by word before it counts.

Null and empty texts have no words and no hits; a null item id is the empty string; items that repeat count once.
Every input row gives one output row, whatever its other columns hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from eventspark.llm.frames import free_name
from eventspark.llm.words import ALNUM, Texts, slices, windows

WINDOW = 10
#: Most benchmark windows broadcast at once: some 120 bytes each, so about 50 MB.
BLOCK_WINDOWS = 400_000
_FILTER_BITS = 20

_FOUND = StructType([
    StructField("n_words", LongType()), StructField("hit_words", ArrayType(LongType())),
    StructField("item_ids", ArrayType(StringType())),
])


def _benchmark_windows(window: int):
    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            texts = Texts([t or b"" for t in raw], lower=True)
            data = texts.data.tobytes()
            hashes, start, end, bound = texts.words(ALNUM)
            out = []
            for k, item in enumerate(ids):
                a, b = int(bound[k]), int(bound[k + 1])
                size = min(window, b - a)
                for j, h in enumerate(windows(hashes[a:b], size).tolist() if size else []):
                    i = a + j
                    out.append((item, size, h - (1 << 63), b" ".join(data[s:e] for s, e in zip(start[i : i + size], end[i : i + size], strict=True))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                ["item", "size", "hash", "words"],
            )

    return windows_of


class _Set:
    """The windows of one block, ready to probe."""

    def __init__(self, rows: list[tuple[str, int, int, bytes]]):
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[tuple[int, bytes], list[str]] = {}
        for item, size, _, words in rows:
            self.items.setdefault((size, words), []).append(item)
        for size in sorted({r[1] for r in rows}):
            known = np.unique(np.array([r[2] + (1 << 63) for r in rows if r[1] == size], np.uint64))
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.sizes[size] = known, seen


def _scan(shared, place: int, last: int):
    """Rows with the text in column `place` and the running result in column `last`, the final one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Set = shared.value
        for batch, raw in slices(batches, place):
            texts = Texts([t or b"" for t in raw], lower=True)
            hashes, start, end, bound = texts.words(ALNUM)
            hit = np.zeros(len(hashes) + 1, np.int32)
            items: list[set[str]] = [set() for _ in raw]
            for size, (known, seen) in block.sizes.items():
                probe = windows(hashes, size)
                maybe = np.flatnonzero(seen[(probe >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                if not len(maybe):
                    continue
                near = np.minimum(np.searchsorted(known, probe[maybe]), len(known) - 1)
                maybe = maybe[known[near] == probe[maybe]]
                doc = np.searchsorted(bound, maybe, "right") - 1
                inside = maybe + size <= bound[doc + 1]
                for i, d in zip(maybe[inside].tolist(), doc[inside].tolist(), strict=True):
                    words = b" ".join(texts.data[s:e].tobytes() for s, e in zip(start[i : i + size], end[i : i + size], strict=True))
                    names = block.items.get((size, words))
                    if names:
                        hit[i] += 1
                        hit[i + size] -= 1
                        items[d].update(names)
            covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
            cut = np.searchsorted(covered, bound)
            before = batch.column(last).to_pylist()
            found = []
            for k in range(len(raw)):
                mine, old = (covered[cut[k] : cut[k + 1]] - bound[k]).tolist(), before[k]
                found.append({
                    "n_words": int(bound[k + 1] - bound[k]),
                    "hit_words": sorted({*mine, *old["hit_words"]}) if old else mine,
                    "item_ids": sorted({*items[k], *old["item_ids"]} if old else items[k]),
                })
            kind = pa.struct([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int64())), ("item_ids", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(found, kind)], names=batch.schema.names)

    return scan


def find_overlap(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
) -> tuple[DataFrame, str]:
    """The rows with a struct of n_words, hit_words (numbers of words inside a benchmark window) and item_ids.

    Returns the DataFrame and the new column's name, `overlap` unless taken.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    all_windows = items.mapInArrow(_benchmark_windows(window), "item string, size long, hash long, words binary").distinct()
    n_blocks = max(1, math.ceil(all_windows.count() / block_windows))
    name, last = free_name(documents, "overlap"), len(documents.columns)
    place = documents.columns.index(text)
    out = documents.withColumn(name, F.lit(None).cast(_FOUND))
    for k in range(n_blocks):
        part = all_windows if n_blocks == 1 else all_windows.where(F.pmod(F.xxhash64("hash"), F.lit(n_blocks)) == k)
        shared = spark.sparkContext.broadcast(_Set([tuple(r) for r in part.collect()]))
        out = out.mapInArrow(_scan(shared, place, last), out.schema)
    return out, name


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", min_hit: int = 1, **names,
) -> DataFrame:
    """Without the rows that have `min_hit` words of benchmark windows, or (`remove="spans"`) without those words.

    A removed span runs from its first word's start to its last word's end. Columns stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found, name = find_overlap(documents, benchmark, text=text, **names)
    if remove == "documents":
        return found.where(F.size(F.col(name)["hit_words"]) < min_hit).drop(name)
    place, last, schema = documents.columns.index(text), len(documents.columns), documents.schema

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, place):
            texts = Texts([t or b"" for t in raw], lower=True)
            _, start, end, bound = texts.words(ALNUM)
            cleaned = []
            for k, (value, found) in enumerate(zip(raw, batch.column(last).to_pylist(), strict=True)):
                hits = np.array(found["hit_words"], np.int64)
                if value is None or len(hits) < min_hit:
                    cleaned.append(value)
                    continue
                first = np.flatnonzero(np.diff(hits, prepend=-2) > 1)
                final = np.append(first[1:], len(hits)) - 1
                at, kept = 0, []
                for a, b in zip(start[bound[k] + hits[first]] - texts.offset[k], end[bound[k] + hits[final]] - texts.offset[k], strict=True):
                    kept.append(value[at:a])
                    at = int(b)
                cleaned.append(b"".join([*kept, value[at:]]))
            columns = list(batch.columns[:last])
            columns[place] = pa.array(cleaned, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])

    return found.mapInArrow(strip, schema)


def overlap_digest(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found, name = find_overlap(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **names)
    hit = F.col(name)
    return found.select(
        "doc_id", hit["n_words"].alias("n_words"), F.size(hit["hit_words"]).cast("long").alias("n_hit"),
        F.size(hit["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["item_ids"], ","), 256).alias("items_sha256"),
        (F.size(hit["hit_words"]) > 0).cast(BooleanType()).alias("contaminated"),
    )

