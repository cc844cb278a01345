"""Document fingerprints by winnowing.

A text is lower-cased (A-Z) and loses its white space; every k-gram of what is left has a 64-bit rolling hash. Of each
window of `WINDOW` neighbouring k-grams the least hash is chosen, the rightmost of equal ones, and chosen once with its
position. So any GRAM + WINDOW - 1 letters that two texts share give a common fingerprint, and no shared passage below
GRAM letters gives one. A text of fewer k-grams than a window is one window; one of fewer letters than GRAM is one gram.

Null texts are empty; texts without letters have no fingerprints and are alike to each other (1) and to nothing else
(0). Otherwise likeness is the Jaccard similarity of the sets of chosen hashes. Long texts are hashed `STEP` letters at
a time, so a text needs some 30 bytes a character. Repeated rows and ties are handled each.

For the digest a document meets the one that follows it. Rows are dealt to ranges of (id, hash of the text, place in
the input), so neither a hot id nor a hot text fills a range; the first document of each range is also sent, once, to
the range before it. The cut points are taken from a sample of at most `SAMPLE` keys; they balance the load and nothing
else. Texts are shuffled once. Places in the input must not change between two readings of it; those of files don't.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from eventspark.llm.frames import free_name, keep, partitions
from eventspark.llm.words import mix

GRAM, WINDOW = 20, 16
STEP, SAMPLE, RANGE_BYTES = 1 << 18, 200_000, 32 << 20
_P = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, STEP + 256), _powers(pow(_P, -1, 1 << 64), STEP + 256)


def letters(text: str) -> np.ndarray:
    """Code points without white space, A-Z as a-z."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    code = code[(code != 32) & ((code < 9) | (code > 13))]
    return np.where((code >= 65) & (code <= 90), code + 32, code)


def gram_hashes(code: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each k-gram of at most STEP + 256 letters, as a difference of running sums moved to the same power."""
    weight = mix((code + np.uint32(1)).astype(np.uint64) * np.uint64(_P))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(weight * _UP[: len(code)], out=total[1:])
    return mix((total[gram:] - total[:-gram]) * _DOWN[: len(code) - gram + 1])


def rightmost_least(values: np.ndarray, window: int) -> np.ndarray:
    """The places that hold the least value, rightmost of equal ones, of some window; window is a power of two."""
    place = np.arange(len(values))
    span = 1
    while span < window:
        take = values[span:] <= values[:-span]
        values = np.where(take, values[span:], values[:-span])
        place = np.where(take, place[span:], place[:-span])
        span *= 2
    return place[np.append(True, place[1:] != place[:-1])]


def winnow(text: str | None, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen, by position; a position counts letters, not white space."""
    code = letters(text or "")
    if not len(code):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = min(gram, len(code))
    grams = len(code) - gram + 1
    if grams < window:
        h = gram_hashes(code, gram)
        at = np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
        return h[at], at
    hashes, places = [], []
    for first in range(0, grams - window + 1, STEP // 2):
        upto = min(first + STEP // 2 + window - 1, grams)
        h = gram_hashes(code[first : upto + gram - 1], gram)
        at = rightmost_least(h, window)
        if places and at[0] + first == places[-1][-1]:
            at = at[1:]
        if len(at):
            hashes.append(h[at])
            places.append(at + first)
    return np.concatenate(hashes), np.concatenate(places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, given distinct and in order."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def pack(hashes: np.ndarray, places: np.ndarray) -> str:
    """Fingerprints as text: base64 of (hash, distance from the position before) as little-endian 64 and 8 bits."""
    rows = np.empty(len(hashes), [("hash", "<u8"), ("gap", "u1")])
    rows["hash"], rows["gap"] = hashes, np.diff(places, prepend=0)
    return base64.b64encode(rows.tobytes()).decode()


def unpack(text: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(base64.b64decode(text), [("hash", "<u8"), ("gap", "u1")])
    return rows["hash"].astype(np.uint64), np.cumsum(rows["gap"].astype(np.int64))


def fingerprints(documents: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW) -> tuple[DataFrame, str]:
    """All columns and an array of (hash, position) of each row's text; and the new column's name, `fingerprints` unless taken."""
    if gram < 1 or gram > 256 or window < 1 or window & (window - 1) or window > 128:
        raise ValueError("a gram has 1 to 256 letters, a window a power of two up to 128 grams")
    name = free_name(documents, "fingerprints")
    place = documents.columns.index(text)
    entry = StructType([StructField("hash", LongType()), StructField("position", LongType())])
    schema = StructType([*documents.schema.fields, StructField(name, ArrayType(entry))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                found = [winnow(t, gram, window) for t in rows.column(place).to_pylist()]
                offset = np.cumsum([0, *(len(h) for h, _ in found)]).astype(np.int32)
                columns = [pa.array(np.concatenate([x[k] for x in found]).astype(np.int64)) for k in (0, 1)]
                entries = pa.StructArray.from_arrays(columns, ["hash", "position"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(offset), entries)], schema.names)

    return documents.mapInArrow(mark, schema), name


def _sortable(key: tuple) -> tuple:
    return tuple((v is not None, 0 if v is None else v) for v in key)


def _followed(names: list[str]):
    """Each document of a range with the one after it; a range's rows come in order, its guest last."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (range, id, text, fingerprint, its set)
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = part.column(2)
                for k, (number, guest, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    text = text or ""
                    if before and before[0] == number and before[2] == text:
                        found, own = before[3], before[4]
                    else:
                        found = winnow(text)
                        own = np.unique(found[0])
                    if before and before[0] == number:
                        out.append((before[1], *_pair(before, text, own)))
                    before = None if guest else (number, ids.slice(k, 1), text, found, own)
                if out:
                    yield _batch(out, names)
                    out = []

    return follow


def _pair(doc: tuple, after: str, after_set: np.ndarray) -> tuple:
    _, _, text, found, own = doc
    cut = len(text) // 4
    edited = text[: len(text) - cut] + after[:cut]
    changed = winnow(edited)
    return (len(text), hashlib.sha256(edited.encode()).hexdigest(), pack(*found), pack(*changed),
            likeness(own, np.unique(changed[0])), likeness(own, after_set))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    columns = [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([r[0] for r in rows]), *columns], names)


def fingerprint_digest(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row.

    The next document is that of the next larger id, null first, equal ids by their text's hash; after the last comes
    the first. Equal rows follow each other.
    """
    spark = documents.sparkSession
    plain = F.coalesce(F.col(text), F.lit(""))
    key = [F.col(doc_id).alias("doc_id"), F.xxhash64(plain).alias("hash"), F.monotonically_increasing_id().alias("place")]
    rows = documents.select(*key, plain.alias("text"))
    keys = keep(documents.select(*key, F.octet_length(plain).alias("bytes")))
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    ranges = max(partitions(spark), math.ceil(size / RANGE_BYTES))
    step = max(1, math.ceil(n / SAMPLE))
    sample = keys.where(F.pmod(F.xxhash64("doc_id", "hash", "place"), F.lit(step)) == 0).select("doc_id", "hash", "place")
    points = sorted(_sortable(r) for r in sample.collect())
    cuts = spark.sparkContext.broadcast([points[k * len(points) // ranges] for k in range(1, ranges)] if points else [])

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array, places: pa.Array) -> pa.Array:
        rows = zip(ids.to_pylist(), hashes.to_pylist(), places.to_pylist(), strict=True)
        return pa.array([bisect_right(cuts.value, _sortable(row)) for row in rows], pa.int32())

    dealt = range_of("doc_id", "hash", "place").alias("range")
    # One row a range: its first document, and the range before it, in a ring.
    first = keys.select("doc_id", "hash", dealt).groupBy("range").agg(F.min(F.struct("doc_id", "hash")).alias("k")).collect()
    first = sorted([(r["range"], r["k"]["doc_id"], r["k"]["hash"]) for r in first], key=lambda r: r[0])
    kind = rows.schema["doc_id"].dataType.simpleString()
    guests = [(first[k - 1][0], at, i, h) for k, (at, i, h) in enumerate(first)]
    wanted = spark.createDataFrame(guests, f"to int, at int, id {kind}, h long")
    rows = rows.select(dealt, "doc_id", "hash", "place", "text")
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")) & (F.col("range") == F.col("at"))
    sent = rows.join(F.broadcast(wanted), match).groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.first("text").alias("text"))
    names = ["range", "guest", "doc_id", "hash", "place", "text"]
    sent = sent.select(F.col("to").alias("range"), F.lit(True).alias("guest"), "doc_id", "hash", F.lit(0).cast("long").alias("place"), "text")
    every = rows.select("range", F.lit(False).alias("guest"), *names[2:]).unionByName(sent)
    order = ["range", "guest", F.col("doc_id").asc_nulls_first(), "hash", "place"]
    every = every.repartitionById(ranges, F.col("range")).sortWithinPartitions(*order).select("range", "guest", "doc_id", "text")
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return every.mapInArrow(_followed(out), schema)
