"""Packing: Karmarkar-Karp multiway differencing into windows of bounded tokens.

A document's ids with its end id are cut into full windows and a rest. Rests are gathered in runs that fill
`RUN_WINDOWS` windows but for `SLACK` ids each, cut at the run's end and into pieces of at most a quarter window; the
last `FINE_SHARE` ids per window are cut into small pieces, which even out the windows. Each piece opens a partial
partition with one loaded window; the two partitions whose heaviest and lightest windows differ most are merged, the
heaviest of one onto the lightest of the other, until one is left. If its heaviest window is beyond the capacity, the
run is done again with one window more.

Runs never cross tasks, so packing shuffles nothing, no source or key can make a task hot, and a task holds one run.
A sequence's id is the task's number and a count. It depends on how the input is split and ordered, as files are.

Null and empty texts are one end id. Repeated rows are packed each; a null id is carried along.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.tokens import encoder, portions

WINDOW, END_ID = 1024, 0
RUN_WINDOWS, SLACK, FINE_SHARE = 64, 8, 128


def _difference(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """(load, pieces) of `windows` sets by merging partitions of opposing imbalance."""
    nothing = (0, ())
    heap = []
    for k, size in enumerate(sizes):
        heap.append((-size, k, [(size, (k,))]))  # lightest windows without pieces are left out of the list
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        room = windows - len(a)
        # a's heaviest come first; b's heaviest go onto a's lightest, which may be empty ones.
        rest = b[room:]
        merged = a + b[:room]
        if rest:
            light = a[len(a) - len(rest):]
            merged = a[: len(a) - len(rest)] + b[:room] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(light, reversed(rest), strict=True)]
        merged.sort(key=lambda x: -x[0])
        lightest = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (lightest - merged[0][0], made, merged))
        made += 1
    out = heap[0][2] if heap else []
    return [(load, _flat(pieces)) for load, pieces in [*out, *[nothing] * (windows - len(out))]]


def _flat(pieces) -> list[int]:
    out, todo = [], [pieces]
    while todo:
        x = todo.pop()
        if isinstance(x, int):
            out.append(x)
        else:
            todo.extend(x)
    return sorted(out)


def differencing(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Sets of the pieces' numbers, none beyond the capacity; each size is at most the capacity."""
    if not sizes:
        return []
    windows = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        found = _difference(sizes, windows)
        if max(load for load, _ in found) <= capacity:
            return [pieces for _, pieces in found if pieces]
        windows += 1


def cut(size: int, most: int) -> list[int]:
    """Sizes of at most `most`, as near equal as can be."""
    n = -(-size // most)
    return [size // n + (k < size % n) for k in range(n)]


def _pack(path: str, window: int, with_ids: bool, names: list[str], pieces: int | None):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pieces)
        number = TaskContext.get().partitionId() << 32
        rests: list[tuple] = []
        held, goal = 0, RUN_WINDOWS * max(1, window - SLACK)

        def place() -> list[tuple]:
            nonlocal number, held
            out, held = [], 0
            for group in differencing([len(r[2]) for r in rests], window):
                at = 0
                for k in group:
                    doc, start, ids, total = rests[k]
                    out.append((doc, start, ids, total, number, at))
                    at += len(ids)
                number += 1
            rests.clear()
            return out

        def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            docs, starts, ids, totals, numbers, places = zip(*rows, strict=True)
            lengths, sums = list(map(len, ids)), list(map(zlib.crc32, ids))
            columns = [pa.array(docs, kind), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals, numbers, places))]
            if with_ids:
                columns.append(pa.array([x.tobytes() for x in ids], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for at, texts in portions(batch.column(1)):
                rows = []
                docs = batch.column(0).slice(at, len(texts)).to_pylist()
                for doc, own in zip(docs, encode.ids(texts), strict=True):
                    ids = np.append(own, np.uint32(END_ID)).astype("<u4", copy=False)
                    full = len(ids) // window * window
                    for start in range(0, full, window):
                        rows.append((doc, start, ids[start : start + window], len(ids), number, 0))
                        number += 1
                    at_id = full
                    while at_id < len(ids):
                        some = min(len(ids) - at_id, goal - held)
                        fine = goal - held - some < FINE_SHARE * RUN_WINDOWS
                        for size in cut(some, max(1, window // 32 if fine else window // 4)):
                            rests.append((doc, at_id, ids[at_id : at_id + size].copy(), len(ids)))
                            at_id += size
                        held += some
                        if held == goal:
                            rows += place()
                if rows:
                    yield batch_of(rows, kind)
        if rests:
            yield batch_of(place(), kind)

    return pack


def pack_documents(
    documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False, pieces: int | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids as bytes).

    `pieces` bounds half the memo that a worker keeps (None: as `tokens` does).
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{n} long" for n in names[1:7])]) + ", ids binary" * with_ids
    return rows.mapInArrow(_pack(tokenizer, window, with_ids, names, pieces), schema.replace("offset long", "`offset` long"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): each sequence's ids as little-endian unsigned 32-bit numbers, from pieces with ids.

    A sequence has at most one window of ids, so its pieces are gathered within a bound.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
