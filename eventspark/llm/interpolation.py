"""LM scoring by deleted interpolation: bigram and unigram maximum-likelihood estimates mixed by context frequency.

p(w | u) = a[b] * c(u w) / c(u) + l[b] * c(w) / N + z[b] / (V + 1), where the bucket b is the bit length of c(u), the
training count of the context u, so a context never seen has its own bucket. The weights of each bucket come from
expectation-maximisation on held-out counts: every training document in turn is deleted, that is scored with its own
counts taken away. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; one end token closes each text, and the start of a
text is the context of its first token. V counts the different training tokens; one more stands for all others.

Texts are read once, into chunks of bounded bytes that hold token numbers and the chunk's different tokens. A count is
asked for by chunk: each chunk sends its different n-grams, already added up, to hash buckets, and gets the totals
back in the same order. So a frequent word costs one row per chunk, and no count table is collected or broadcast. A
bigram with a word that no other chunk has is settled inside its chunk and isn't asked for. Only the EM's table
goes to the driver: sums by bucket and by half-octaves of the two estimates, at most some 10,000 rows at any size.

Null and empty texts are one end token. A null id is an id like any other; repeated rows are scored each. A document
whose training mark is null trains. Without training tokens every score is uniform over the one unknown token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.frames import keep, partitions
from eventspark.llm.words import SPACED, Texts, U, mix, slices

CHUNK = 9 << 20
#: Different n-grams that one hash bucket's task adds up.
BUCKET_KEYS = 1_000_000
ROUNDS, LEVELS = 40, 40
END = mix(np.array([1], U))[0]
_PAIR = U(0x9E3779B97F4A7C15)
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(a: np.ndarray) -> bytes:
    """Numbers as zstandard of their byte planes."""
    return len(a).to_bytes(4, "little") + a.dtype.char.encode() + _PACK.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    n, kind = int.from_bytes(b[:4], "little"), np.dtype(b[4:5].decode())
    planes = np.frombuffer(_UNPACK.decompress(b[5:]), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=U(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=U)


_CHUNK = "chunk long, docs binary, n_train long, n_docs_train long, n_unique long, doc_tokens binary, trains binary, unique binary, tokens binary"


def _read_chunks():
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0
        for batch, raw in slices(batches, 1):
            held.append((batch.column(0), batch.column(2), raw))
            size += sum(len(t) + 16 for t in raw if t is not None)
            if size >= CHUNK:
                yield _chunk(held, (task << 32) | made)
                held, size, made = [], 0, made + 1
        if held:
            yield _chunk(held, (task << 32) | made)

    return read


def _chunk(held: list[tuple], number: int) -> pa.RecordBatch:
    parts, per_doc = [], []
    for _, _, raw in held:
        hashes, _, _, bound = Texts([t or b"" for t in raw], lower=True).words(SPACED)
        parts.append(np.insert(hashes, bound[1:], END))
        per_doc.append(np.diff(bound) + 1)
    ids = pa.concat_arrays([c for c, _, _ in held])
    trains = np.concatenate([np.array(c.to_pylist(), bool) for _, c, _ in held])
    unique, tokens = np.unique(np.concatenate(parts), return_inverse=True)
    count = np.concatenate(per_doc).astype(np.uint32)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as writer:
        writer.write_batch(pa.record_batch([ids], ["id"]))
    row = [number, sink.getvalue().to_pybytes(), int(count[trains].sum()), int(trains.sum()), len(unique), _pack(count), _pack(trains), _pack_sorted(unique), _pack(tokens.astype(np.uint32))]
    names = ["chunk", "docs", "n_train", "n_docs_train", "n_unique", "doc_tokens", "trains", "unique", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)


class _Chunk:
    """A chunk's arrays; `total` is each different token's training count and `elsewhere` whether another chunk has
    the token, once they are known.
    """

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.ids = pa.ipc.open_stream(row["docs"]).read_all().column(0)
        self.per_doc, self.trains = _unpack(row["doc_tokens"]).astype(np.int64), _unpack(row["trains"])
        self.unique, self.tokens = _unpack_sorted(row["unique"]), _unpack(row["tokens"]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.per_doc)), self.per_doc)
        self.training = self.trains[self.doc]
        self.own = np.bincount(self.tokens[self.training], minlength=len(self.unique))

    def pairs(self) -> None:
        """Different (context, token) pairs; the start of a text is the context numbered after the last token."""
        n = len(self.unique)
        context = np.empty(len(self.tokens), np.int64)
        context[1:] = self.tokens[:-1]
        first = np.concatenate([[0], np.cumsum(self.per_doc)])[:-1]
        context[first] = n
        self.context = context
        self.pair, self.which = np.unique(context * (n + 1) + self.tokens, return_inverse=True)
        self.left, self.right = self.pair // (n + 1), self.pair % (n + 1)
        self.pair_own = np.bincount(self.which[self.training], minlength=len(self.pair))

    def asked_pairs(self, starts: int) -> np.ndarray:
        """Pairs that other chunks may hold too, as numbers into `pair`."""
        self.totals = np.append(self.total, starts)
        return np.flatnonzero(np.append(self.elsewhere, True)[self.left] & self.elsewhere[self.right])

    def pair_keys(self, asked: np.ndarray) -> np.ndarray:
        names = np.append(self.unique, U(0))
        return mix(names[self.left[asked]] * _PAIR + mix(names[self.right[asked]]))


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by bucket and key, and where each bucket starts in it (one more at the end)."""
    bucket = (keys % U(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_ASK = "bucket long, chunk long, keys binary, own binary"
_TOLD = "chunk long, bucket long, totals binary, n_new long"


def _request(number: int, keys: np.ndarray, own: np.ndarray, buckets: int) -> pa.Table:
    order, at = _by_bucket(keys, buckets)
    rows = [(k, order[at[k] : at[k + 1]]) for k in range(buckets) if at[k + 1] > at[k]]
    return pa.table({
        "bucket": pa.array([k for k, _ in rows], pa.int64()), "chunk": pa.array([number] * len(rows), pa.int64()),
        "keys": pa.array([_pack_sorted(keys[w]) for _, w in rows], pa.binary()),
        "own": pa.array([_pack(own[w].astype(np.uint32)) for _, w in rows], pa.binary())})


def _ask_tokens(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row)
                yield from _request(chunk.number, chunk.unique, chunk.own, buckets).to_batches()

    return ask


def _add_up(key, table):
    """Totals of a bucket's keys, in the order each chunk asked; n_new counts keys with a total, once a bucket.

    A total is told as twice its value, and one more if another chunk has the key, too.
    """
    asked = [_unpack_sorted(b) for b in table["keys"].to_pylist()]
    own = np.concatenate([_unpack(b) for b in table["own"].to_pylist()])
    known, which = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(which, weights=own, minlength=len(known)).astype(np.uint64)
    cut = np.cumsum([len(a) for a in asked])[:-1]
    answer = total * U(2) + (np.bincount(which) > 1)
    told = [_pack(t if t.max() >= 1 << 32 else t.astype(np.uint32)) for t in np.split(answer[which], cut)]
    n = len(told)
    return pa.table({
        "chunk": table["chunk"], "bucket": table["bucket"], "totals": pa.array(told, pa.binary()),
        "n_new": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64())})


def _totals(requests: DataFrame) -> DataFrame:
    return keep(requests.groupBy("bucket").applyInArrow(_add_up, _TOLD))


def _answers(table, buckets: int, keys: np.ndarray) -> np.ndarray:
    """The totals for keys from the told rows of one chunk."""
    order, at = _by_bucket(keys, buckets)
    out = np.zeros(len(keys), np.int64)
    for bucket, totals in zip(table["bucket"].to_pylist(), table["totals"].to_pylist(), strict=True):
        out[order[at[bucket] : at[bucket + 1]]] = _unpack(totals)
    return out


def _level(f: np.ndarray) -> np.ndarray:
    """Half-octave of an estimate: 0 for none, 1 for one, up to LEVELS."""
    out = np.zeros(len(f), np.int64)
    some = f > 0
    out[some] = np.minimum(1 + np.floor(-2 * np.log2(f[some])).astype(np.int64), LEVELS)
    return out


def _bucket_of(count: np.ndarray) -> np.ndarray:
    """Bit length of a context's count."""
    return np.frexp(count.astype(np.float64))[1]


def _ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


class _Sizes:
    def __init__(self, tokens: int, different: int, starts: int, token_buckets: int, pair_buckets: int):
        self.tokens, self.different, self.starts = tokens, different, starts
        self.token_buckets, self.pair_buckets = token_buckets, pair_buckets


def _known(row: dict, told, sizes: _Sizes) -> tuple[_Chunk, np.ndarray]:
    """The chunk with token totals, its pairs, and the pairs to ask for."""
    chunk = _Chunk(row)
    answer = _answers(told.filter(pc.equal(told["kind"], 1)), sizes.token_buckets, chunk.unique)
    chunk.total, chunk.elsewhere = answer >> 1, answer & 1 > 0
    chunk.pairs()
    return chunk, chunk.asked_pairs(sizes.starts)


def _ask_pairs(sizes: _Sizes):
    def ask(chunks, told):
        chunk, asked = _known(chunks.to_pylist()[0], told, sizes)
        return _request(chunk.number, chunk.pair_keys(asked), chunk.pair_own[asked], sizes.pair_buckets)

    return ask


def _with_pairs(chunks, told, sizes: _Sizes) -> tuple[_Chunk, np.ndarray]:
    chunk, asked = _known(chunks.to_pylist()[0], told, sizes)
    totals = chunk.pair_own.astype(np.int64)
    totals[asked] = _answers(told.filter(pc.equal(told["kind"], 2)), sizes.pair_buckets, chunk.pair_keys(asked)) >> 1
    return chunk, totals


def _deleted_counts(sizes: _Sizes):
    """Held-out counts: training tokens by context bucket and estimates without their own document."""

    def cells(chunks, told):
        chunk, totals = _with_pairs(chunks, told, sizes)
        t = chunk.training
        doc, token, which, context = chunk.doc[t], chunk.tokens[t], chunk.which[t], chunk.context[t]

        def within(names: np.ndarray) -> np.ndarray:
            _, at, times = np.unique(doc * (len(chunk.pair) + 1) + names, return_inverse=True, return_counts=True)
            return times[at]

        mine = within(token)
        c_pair = totals[which] - within(which)
        c_word = chunk.totals[token] - mine
        # A word is the context of the token after it, so the document has a context as often as that word.
        start = context == len(chunk.unique)
        order = np.argsort(doc * (len(chunk.unique) + 2) + token, kind="stable")
        sorted_names = (doc * (len(chunk.unique) + 2) + token)[order]
        wanted = doc * (len(chunk.unique) + 2) + context
        own_context = np.searchsorted(sorted_names, wanted, "right") - np.searchsorted(sorted_names, wanted)
        c_context = chunk.totals[context] - np.where(start, 1, own_context)
        n = sizes.tokens - chunk.per_doc[doc]
        f2, f1 = _ratio(c_pair, c_context), _ratio(c_word, n)
        cell = (_bucket_of(c_context) * (LEVELS + 1) + _level(f2)) * (LEVELS + 1) + _level(f1)
        known, at, times = np.unique(cell, return_inverse=True, return_counts=True)
        return pa.table({
            "cell": pa.array(known, pa.int64()), "n": pa.array(times, pa.int64()),
            "f2": pa.array(np.bincount(at, f2, len(known)), pa.float64()), "f1": pa.array(np.bincount(at, f1, len(known)), pa.float64())})

    return cells


def learn_weights(cells: list[tuple[int, int, float, float]], different: int, rounds: int = ROUNDS) -> np.ndarray:
    """EM: for each context bucket the weights of bigram, unigram and uniform estimate."""
    weights = np.tile([0.0, 0.5, 0.5], (65, 1))
    uniform = 1 / (different + 1)
    for bucket in {c // (LEVELS + 1) ** 2 for c, *_ in cells}:
        mine = [(n, f2 / n, f1 / n) for c, n, f2, f1 in cells if c // (LEVELS + 1) ** 2 == bucket]
        n = np.array([m[0] for m in mine], float)
        f = np.array([[m[1], m[2], uniform] for m in mine])
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = f * w
            share /= share.sum(axis=1, keepdims=True)
            w = (n[:, None] * share).sum(axis=0) / n.sum()
        # A little for the uniform estimate, or a word never seen would have no probability.
        w = np.maximum(w, 1e-9)
        weights[bucket] = w / w.sum()
    if (weights[:, 0] == 0).all():
        return weights
    trained = np.flatnonzero(weights[:, 0] > 0)
    for bucket in range(65):  # a bucket without held-out tokens takes the nearest one's weights
        if bucket and weights[bucket, 0] == 0:
            weights[bucket] = weights[trained[np.argmin(np.abs(trained - bucket))]]
    return weights


def _score(sizes: _Sizes, weights: np.ndarray, names: list[str]):
    def score(chunks, told):
        chunk, totals = _with_pairs(chunks, told, sizes)
        count = chunk.total[chunk.tokens]
        context = chunk.totals[chunk.context]
        w = weights[_bucket_of(context)]
        p = w[:, 0] * _ratio(totals[chunk.which], context) + w[:, 1] * _ratio(count, sizes.tokens) + w[:, 2] / (sizes.different + 1)
        base = np.log10((count + 0.5) / (sizes.tokens + 0.5 * (sizes.different + 1)))
        first = np.concatenate([[0], np.cumsum(chunk.per_doc)])[:-1]
        n = len(chunk.per_doc)
        return pa.table([
            chunk.ids, pa.array(~chunk.trains), pa.array(chunk.per_doc), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
            pa.array(np.full(n, sizes.tokens, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))], names)

    return score


def deleted_interpolation(documents: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every row by a model of the rows that `trains` marks.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams) and score.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.coalesce(trains, F.lit(True)).alias("trains"))
    id_type = rows.schema["id"].dataType.simpleString()
    chunks = keep(rows.mapInArrow(_read_chunks(), _CHUNK))
    tokens, starts, keys = chunks.agg(F.sum("n_train"), F.sum("n_docs_train"), F.sum("n_unique")).first()
    token_buckets = max(partitions(spark), math.ceil((keys or 0) / BUCKET_KEYS))
    told1 = _totals(chunks.mapInArrow(_ask_tokens(token_buckets), _ASK)).withColumn("kind", F.lit(1))
    different = told1.agg(F.sum("n_new")).first()[0] or 0
    pair_buckets = token_buckets * 4
    sizes = _Sizes(tokens or 0, different, starts or 0, token_buckets, pair_buckets)
    told2 = _totals(chunks.groupBy("chunk").cogroup(told1.groupBy("chunk")).applyInArrow(_ask_pairs(sizes), _ASK)).withColumn("kind", F.lit(2))
    told = told1.union(told2)
    grouped = chunks.groupBy("chunk").cogroup(told.groupBy("chunk"))
    cells = keep(grouped.applyInArrow(_deleted_counts(sizes), "cell long, n long, f2 double, f1 double"))
    table = cells.groupBy("cell").agg(F.sum("n"), F.sum("f2"), F.sum("f1")).collect()
    weights = learn_weights([tuple(r) for r in table], different)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return grouped.applyInArrow(_score(sizes, weights, names), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
