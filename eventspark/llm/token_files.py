"""Token ids as files: one zstandard frame per document, with a dictionary shared by all of them.

A corpus is a folder with two tables. `dictionary` has one row: the dictionary, its sha256 and the width of an id in
bytes (2 if the vocabulary allows, else 4; little-endian, unsigned). `blocks` has rows of up to `BLOCK_DOCS` documents
or `BLOCK_IDS` ids in ascending order of document ids: their ids' column, the count of token ids of each, the frames
one after another, and where each frame starts (one more at the end); with the dictionary's sha256, which a reader
compares. So one short document is read by its block's index and one frame. Parts ascend too: rows are range-
partitioned by document id, and among equal ids by the text's hash.

The dictionary is trained on the whole ids of at most `SAMPLE_DOCS` documents, chosen by hash of their id; if they are
too few for training, their bytes themselves are the dictionary. Null ids come first; null and empty texts are the end
id alone; repeated rows are written each; extra columns are not written. An empty table gives no blocks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventspark.llm.tokens import encoder, portions

END_ID, SAMPLE_DOCS, DICTIONARY_BYTES, LEVEL = 2, 2000, 64 << 10, 3
BLOCK_DOCS, BLOCK_IDS = 1000, 1 << 21
_BLOCK = "part long, block long, dictionary_sha256 string, n_ids long, doc_ids binary, counts binary, frame_at binary, frames binary"


def _ids(encode, texts: list[str | None], end: int, kind: str) -> list[bytes]:
    last = np.array([end], kind).tobytes()
    return [ids.astype(kind).tobytes() + last for ids in encode.ids(texts)]


def _ipc(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", column.type)])) as writer:
        writer.write_batch(pa.record_batch([column], ["id"]))
    return sink.getvalue().to_pybytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too small
        return b"".join(samples)[-size:]


def _kind(tokenizer: str) -> str:
    return "<u2" if len(encoder(tokenizer).raw) <= 1 << 16 else "<u4"


def _write_blocks(tokenizer: str, end: int, kind: str, shared):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dictionary = encoder(tokenizer), shared.value
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        sha, part, number = hashlib.sha256(dictionary).hexdigest(), TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        counts: list[int] = []
        frames: list[bytes] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            at = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8").tobytes()
            row = [part, number, sha, sum(counts), _ipc(pa.concat_arrays(docs)), np.array(counts, "<u4").tobytes(), at, b"".join(frames)]
            number += 1
            for held_back in (docs, counts, frames):
                held_back.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], [c.split()[0] for c in _BLOCK.split(", ")])

        size, held = np.dtype(kind).itemsize, 0
        for batch in batches:
            ids, taken = batch.column(0), 0
            for at, texts in portions(batch.column(1)):
                for k, raw in enumerate(_ids(encode, texts, end, kind), at + 1):
                    counts.append(len(raw) // size)
                    frames.append(pack.compress(raw))
                    held += counts[-1]
                    if len(counts) >= BLOCK_DOCS or held >= BLOCK_IDS:
                        docs.append(ids.slice(taken, k - taken))
                        taken, held = k, 0
                        yield block()
            docs.append(ids.slice(taken))
        if counts:
            yield block()

    return blocks


def write_corpus(documents: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END_ID) -> None:
    """Write all rows in ascending order of their ids; `path` must not exist."""
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = _kind(tokenizer)
    some = max(1, math.ceil(rows.count() / SAMPLE_DOCS))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = encoder(tokenizer)
            for _, texts in portions(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_ids(encode, texts, end, kind), pa.binary())], ["ids"])

    chosen = rows.where(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(some)) == 0).select("text").limit(SAMPLE_DOCS)
    samples = sorted(r.ids for r in chosen.mapInArrow(sample, "ids binary").collect())
    dictionary = train_dictionary(samples) if samples else b""
    row = [(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest(), np.dtype(kind).itemsize)]
    spark.createDataFrame(row, "dictionary binary, sha256 string, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shared = spark.sparkContext.broadcast(dictionary)
    ranged.mapInArrow(_write_blocks(tokenizer, end, kind, shared), _BLOCK).write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary isn't the one that was written")
    return dictionary, row["sha256"], "<u2" if row["width"] == 2 else "<u4"


def read_corpus(spark: SparkSession, path: str, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 of the ids as unsigned 32-bit (and these as bytes)."""
    dictionary, sha, kind = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(dictionary)
    names = ["doc_id", "part", "block", "within", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                docs = pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).combine_chunks()
                at, data = np.frombuffer(row["frame_at"], "<u8").tolist(), row["frames"]
                ids = [np.frombuffer(unpack.decompress(data[a:b]), kind).astype("<u4") for a, b in zip(at, at[1:], strict=False)]
                count = np.array([len(x) for x in ids], np.int64)
                n = len(ids)
                columns = [docs, *(pa.array(np.full(n, row[c], np.int64)) for c in ("part", "block")), pa.array(np.cumsum(count) - count), pa.array(count),
                           pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x.tobytes() for x in ids], pa.binary())] * with_ids, names)

    blocks = spark.read.parquet(f"{path}/blocks")
    schema = f"doc_id {id_type}, part long, block long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    sizes = blocks.select("part", "block", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_at"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_at")).join(parts, "part")
    found = blocks.mapInArrow(decode, schema).join(offsets, ["part", "block"])
    start = (F.col("part_at") + F.col("block_at") + F.col("within")).alias("start")
    return found.select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_document(spark: SparkSession, path: str, doc_id) -> list[np.ndarray]:
    """The ids of the documents with this id, by their blocks' indexes; other frames stay packed."""
    dictionary, _, kind = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(dictionary)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        for batch in batches:
            for row in batch.to_pylist():
                docs = pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).to_pylist()
                at = np.frombuffer(row["frame_at"], "<u8").tolist()
                own = [unpack.decompress(row["frames"][at[k] : at[k + 1]]) for k, d in enumerate(docs) if d == doc_id]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], ["ids"])

    blocks = spark.read.parquet(f"{path}/blocks").select("doc_ids", "frame_at", "frames")
    return [np.frombuffer(bytes(r.ids), kind) for r in blocks.mapInArrow(pick, "ids binary").collect()]
