"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (3 to 5) of a text's words, A-Z lowered, each word between two boundary signs,
hashed into 2**18 and counted as present or not. For a feature present in p of P toxic and q of Q other training texts
r = log(((p + 1) / (P + 2)) / ((q + 1) / (Q + 2))). The features of the largest likelihood-ratio statistic are kept;
a logistic regression with L2 penalty is fitted on features of value r. The score is its probability.

The model is fitted on at most `TRAIN_ROWS` labelled rows of at most as many ids, those of the least hash. Rows of one
id and text count once; of an id with n texts each hash counts n times, so ids take turns and none drives the fit. Spark
makes and counts the features; the fit sees some 5 MB, and 4 bytes for each chosen feature of a row at most. Scoring runs over whole texts of all rows.

Null and empty texts have no features and get the model's prior. Labels other than 0 and 1 don't count; an id that is
labelled twice takes the larger label; null ids have no labels. Without both labels the score is the share of toxic
labels (0 without any).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.frames import free_name, keep
from eventspark.llm.words import SPACED, Texts, U, mix, slices

TRAIN_ROWS = 20_000
#: Training rows of one task.
TASK_ROWS = 1250
ORDERS, BITS, FEATURES = (3, 4, 5), 18, 1500
PENALTY, STEPS, INNER = 1e-3, 15, 40
_BOUNDARY = 10
#: Bytes of text whose features of all kinds are held at a time.
COUNT_SLICE = 1 << 18


def _word_grams(words: list[bytes], chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of each different feature of each word; only chosen features, if given."""
    text = (b"\n" + b"\n".join(words) + b"\n").decode("utf-8", "replace").encode("utf-32-le")
    points = np.frombuffer(text, "<u4")
    edge = points == _BOUNDARY
    number = np.cumsum(edge) - 1
    spread = mix(points.astype(U) + U(1))
    pairs = []
    for n in ORDERS:
        if len(points) < n:
            continue
        size = len(points) - n + 1
        h = np.full(size, n, U)
        inner = np.zeros(size, bool)
        for k in range(n):
            h = h * U(0x9E3779B97F4A7C15) + spread[k : k + size]
            if 0 < k < n - 1:
                inner |= edge[k : k + size]
        feature = ((h * U(0xBF58476D1CE4E5B9)) >> U(64 - BITS)).astype(np.int64)
        good = np.flatnonzero(~inner if chosen is None else chosen[feature] & ~inner)
        word, feature = number[good], feature[good]  # a leading boundary opens the word after it
        pairs.append((word << BITS) | feature)
    both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def _doc_features(raw: list[bytes | None], chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each different feature of each text; only chosen features, if given."""
    texts = Texts([t or b"" for t in raw], lower=True)
    hashes, start, end, bound = texts.words(SPACED)
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    data = texts.data.tobytes()
    word, feature = _word_grams([data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], chosen)
    doc = np.repeat(np.arange(len(raw)), np.diff(bound))
    per_word = np.bincount(word, minlength=len(first))
    has = per_word[which] > 0
    pair = np.unique(doc[has] * len(first) + which[has])
    doc, which = pair // len(first), pair % len(first)
    at = np.concatenate([[0], np.cumsum(per_word)])[:-1]
    times = per_word[which]
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(at[which], times)
    both = np.unique((np.repeat(doc, times) << BITS) | feature[place])
    return both >> BITS, both & ((1 << BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch, raw in slices(batches, 0, COUNT_SLICE):
        label = np.array(batch.column(1).to_pylist(), np.int64)
        doc, feature = _doc_features(raw, None)
        for k in (0, 1):
            seen[k] += np.bincount(feature[label[doc] == k], minlength=1 << BITS)
    some = np.flatnonzero(seen.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], ["feature", "clean", "toxic"])


class Model:
    """Chosen features, their weights times ratios, and the bias."""

    def __init__(self, weight: dict[int, float], bias: float):
        self.bias = bias
        self.weight = np.zeros(1 << BITS)
        self.chosen = np.zeros(1 << BITS, bool)
        for feature, w in weight.items():
            self.weight[feature] = w
            self.chosen[feature] = True

    def scores(self, raw: list[bytes | None]) -> np.ndarray:
        doc, feature = _doc_features(raw, self.chosen)
        z = self.bias + np.bincount(doc, self.weight[feature], minlength=len(raw))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _statistic(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Likelihood-ratio statistic of a feature and the label."""
    n, total = n_clean + n_toxic, clean + toxic
    out = np.zeros(len(clean))
    for seen, share in ((clean, n_clean / n), (toxic, n_toxic / n), (n_clean - clean, n_clean / n), (n_toxic - toxic, n_toxic / n)):
        of = total if seen is clean or seen is toxic else n - total
        want = np.maximum(of * share, 1e-12)
        out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / want), 0)
    return 2 * out


def _fit(rows: list[tuple[int, bytes]], ratio: dict[int, float]) -> Model:
    """Logistic regression by Newton steps over all given rows."""
    names = np.array(sorted(ratio))
    scale = np.array([ratio[f] for f in names])
    y = np.array([label for label, _ in rows], float)
    found = [np.frombuffer(b, "<i4") for _, b in rows]
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    column = np.searchsorted(names, np.concatenate(found)) if len(row) else np.empty(0, np.int64)
    value = scale[column]
    n, m = len(rows), len(names)
    # The bias is one more column, of ones and without penalty.
    row, column, value = np.append(row, np.arange(n)), np.append(column, np.full(n, m)), np.append(value, np.ones(n))
    penalty = np.append(np.full(m, PENALTY), 0.0)
    w = np.zeros(m + 1)
    w[m] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    for _ in range(STEPS):  # Newton's steps, each solved by conjugate gradients
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column] * value, n), -500, 500)))
        gradient = np.bincount(column, (p - y)[row] * value, m + 1) / n + penalty * w
        if np.abs(gradient).max() < 1e-7:
            break
        bend = np.maximum(p * (1 - p), 1e-6)
        step, left = np.zeros(m + 1), -gradient
        way, size = left.copy(), left @ left
        for _ in range(INNER):
            curved = np.bincount(column, (bend * np.bincount(row, way[column] * value, n))[row] * value, m + 1) / n + penalty * way
            go = size / (way @ curved)
            step, left = step + go * way, left - go * curved
            size, old = left @ left, size
            if size < 1e-18:
                break
            way = left + size / old * way
        w = w + step
    w, b = w[:m], float(w[m])
    return Model(dict(zip(names.tolist(), (w * scale).tolist(), strict=True)), b)


def train(documents: DataFrame, labels: DataFrame, learns: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows that `learns` (an expression of `doc_id`) marks.

    Only labels of documents that are there count towards `limit`. Without rows of both classes there is nothing to
    learn: every row then gets the score of the only class, and a warning says so.
    """
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(learns & F.col("label").isin(0, 1))
    marked = marked.join(documents.select(F.col(doc_id).alias("doc_id")).distinct(), "doc_id", "left_semi")
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    # At most `limit` rows of numbers are broadcast each time; texts are read when the rows are chosen.
    keys = keep(rows.join(F.broadcast(marked), "doc_id").select("doc_id", "hash", "label").distinct())
    turn = F.col("n") * (F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53)))
    texts_of = keys.groupBy("doc_id").agg(F.count("*").alias("n"))
    chosen = keys.join(F.broadcast(texts_of), "doc_id").orderBy(turn, "hash", "doc_id").limit(limit).select("doc_id", "hash", "label")
    rows = rows.join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
    rows = keep(rows.select("text", "label").repartition(-(-limit // TASK_ROWS)))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        warnings.warn(f"{n_toxic} toxic and {n_clean} other labelled texts: every score is the same", stacklevel=2)
        return Model({}, 500.0 if n_toxic else -500.0)
    counts = rows.mapInArrow(_count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean"), F.sum("toxic"))
    feature, clean, toxic = np.array([tuple(r) for r in counts.collect()] or [(0, 0, 0)], np.int64).T
    best = np.lexsort((feature, -_statistic(clean, toxic, n_clean, n_toxic)))[:FEATURES]
    ratio = np.log((toxic[best] + 1) / (n_toxic + 2)) - np.log((clean[best] + 1) / (n_clean + 2))
    ratio = dict(zip(feature[best].tolist(), ratio.tolist(), strict=True))
    chosen = Model(dict.fromkeys(ratio, 0.0), 0.0).chosen

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 0):
            doc, feature = _doc_features(raw, chosen)
            cut = np.searchsorted(doc, np.arange(len(raw) + 1))
            own = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.binary())], ["label", "features"])

    return _fit(sorted(tuple(r) for r in rows.mapInArrow(pick, "label int, features binary").collect()), ratio)


def with_score(documents: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """All rows and columns with the score; returns the new column's name, `toxic_score` unless taken."""
    name, place = free_name(documents, "toxic_score"), documents.columns.index(text)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = documents.withColumn(name, F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, place):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(raw))], names=[*batch.schema.names, name])

    return documents.mapInArrow(score, schema), name


def toxicity_digest(documents: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out rows are never read."""
    model = train(documents, labels, ~held_out)
    scored, name = with_score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(name).alias("score"),
        (F.col(name) >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, held_out: Column, limit: float = 0.5) -> DataFrame:
    """The rows that score below `limit`, with their columns as they are."""
    scored, name = with_score(documents, train(documents, labels, ~held_out))
    return scored.where(F.col(name) < limit).drop(name)
