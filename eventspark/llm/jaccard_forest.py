"""N-gram Jaccard join by the one level of a MinHash LSH forest that a threshold needs, then exact verification.

A document's set holds the 64-bit hashes of its runs of `size` words (`[^\\x20\\x09-\\x0D]+`, A-Z lowered); a document
of fewer words, but not none, has the one run of all its words. Documents with equal sets are one text class and are
compared once. Each of `TREES` trees has a sequence of minima; a node is a prefix of it. The prefix has one depth,
the largest up to `MAX_DEPTH` at which a pair at the threshold shares a node in some tree with at least the target
recall. It follows from threshold and recall alone (4 for the defaults), so tries are neither built nor walked: who
shares a longer prefix shares this one, too, so levels matched before it would add no pair. This equals banded LSH of
`TREES` bands. A forest's shortening by what was matched serves searches for the k nearest, not all pairs. Nodes with the same members in several trees are compared in one of them. Members of
a node are compared in blocks of bounded bytes, so a node of any size is spread over tasks, and only counts and one
edge per member leave a task, never pairs. A pair counts in the first tree where it meets, so counts are exact.

Null texts are linked to nothing and are their own class. Texts without a word have equal (empty) sets. A null id
never names a class that has another. Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.frames import free_name, keep
from eventspark.llm.words import SPACED, Texts, U, mix, slices, windows

SIZE, SIMILARITY, RECALL = 5, 0.8, 0.9999
TREES, MAX_DEPTH = 20, 8
#: Members and shingles in a block of a node; a task holds two blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1_000_000

_RANDOM = np.random.default_rng(20)
_FLIP = _RANDOM.integers(0, 1 << 63, TREES * MAX_DEPTH, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 63, TREES * MAX_DEPTH, dtype=np.uint64) * U(2) + U(1)


def expected_recall(similarity: float, depth: int) -> float:
    """Chance that a pair of this similarity shares a node of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_depth(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Shorten the matched prefix until pairs at the threshold meet in some tree with the target recall."""
    depth = MAX_DEPTH
    while depth > 1 and expected_recall(similarity, depth) < recall:
        depth -= 1
    return depth


def _sets(raw: list[bytes | None], size: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The sorted shingle hashes of each text and the key of its set (None for a null text)."""
    hashes, _, _, bound = Texts([t or b"" for t in raw], lower=True).words(SPACED)
    sets, keys = [], []
    for k, text in enumerate(raw):
        words = hashes[bound[k] : bound[k + 1]]
        found = np.unique(windows(words, min(size, len(words)))) if len(words) else words
        sets.append(found)
        keys.append(None if text is None else hashlib.blake2b(found.tobytes(), digest_size=16).digest())
    return sets, keys


def _prefixes(sets: list[np.ndarray], depth: int) -> np.ndarray:
    """The node of each set in each tree, as one row of hashes; zero for an empty set."""
    out = np.zeros((len(sets), TREES), U)
    some = [k for k, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[k] for k in some])
        at = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])])[:-1]
        for tree in range(TREES):
            node = np.full(len(some), tree + 1, U)
            for level in range(tree * MAX_DEPTH, tree * MAX_DEPTH + depth):
                node = mix(node + np.minimum.reduceat((flat ^ _FLIP[level]) * _ODD[level], at))
            out[some, tree] = node
    return out


def _sign(size: int, depth: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 1):
            sets, keys = _sets(raw, size)
            nodes = _prefixes(sets, depth).view(np.int64)
            count = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(count),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * TREES), pa.array(nodes.ravel()))],
                ["doc", "text_hash", "set_key", "n_shingles", "nodes"],
            )

    return sign


def _fetch(size: int, depth: int):
    """Sets of the wanted rows; a row whose set is another (an id and a text hash that repeat) is left out."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 0):
            sets, keys = _sets(raw, size)
            right = [k for k, key in enumerate(batch.column(1).to_pylist()) if key == keys[k]]
            sets = [sets[k] for k in right]
            nodes = _prefixes(sets, depth)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in right], pa.binary()), batch.column(2).take(pa.array(right, pa.int64())),
                 pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([n.tobytes() for n in nodes], pa.binary())],
                ["set_key", "n_copies", "shingles", "nodes"],
            )

    return fetch


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share; a set with itself is left at no certain value."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[0, both], [both, 0]])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    use = shared[which]
    owner, column = owner[use], column[which[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, step = np.zeros((m, m), np.float32), max(1, (4 << 20) // m)
    for first in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [first, first + step])
        part = np.zeros((m, step), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _verify(similarity: float):
    kind = pa.schema([("set_key", pa.binary()), ("hub", pa.binary()), ("n_links", pa.int64()), ("n_texts", pa.int64())])

    def verify(key, table):
        tree, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
        names = table["set_key"].to_pylist()
        sets = [np.frombuffer(b, U) for b in table["shingles"].to_pylist()]
        if len(sets) < 2:
            return kind.empty_table()
        nodes = np.stack([np.frombuffer(b, U) for b in table["nodes"].to_pylist()])
        copies, block = np.array(table["n_copies"].to_pylist()), np.array(table["block"].to_pylist())
        length = np.array([len(s) for s in sets])
        both = _common(sets)
        link = both >= similarity * (length[:, None] + length[None, :] - both)
        np.fill_diagonal(link, False)
        if low != high:
            link &= block[:, None] != block[None, :]
        for earlier in range(tree):
            link &= nodes[:, None, earlier] != nodes[None, :, earlier]
        any_link = link.any(axis=1)
        link = link[any_link][:, any_link]
        names = [n for n, x in zip(names, any_link, strict=True) if x]
        order = np.argsort(np.array(names, "S16")) if names else np.empty(0, int)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        while len(names):
            better = np.minimum(rank, np.where(link, rank[None, :], len(names)).min(axis=1))
            if (better == rank).all():
                break
            rank = better
        return pa.Table.from_arrays(
            [pa.array(names, pa.binary()), pa.array([names[order[r]] for r in rank], pa.binary()),
             pa.array((link @ copies[any_link]).astype(np.int64)), pa.array(link.sum(axis=1).astype(np.int64))], schema=kind,
        )

    return verify


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected part. `edges` has a and b; every round halves the ways."""
    edges = keep(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
    labels = keep(labels)
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = keep(step.join(up, "label").select("node", "old", F.col("top").alias("label")))
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def text_classes(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> tuple[DataFrame, DataFrame]:
    """(doc, set_key) of every row, and per set with a copy or a link: its class, links and copies.

    The second has set_key, class_id (least id of the class), label (of the class), n_links, n_texts, n_copies, and
    chosen for one set of each class: the least of those with the class's id.
    """
    depth = prefix_depth(similarity, recall)
    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    id_type = rows.schema["doc"].dataType.simpleString()
    signed = keep(rows.mapInArrow(_sign(size, depth), f"doc {id_type}, text_hash long, set_key binary, n_shingles long, nodes array<long>"))
    # The row of a set that is read again: of the least id, found by the id and the hash of its text.
    sets = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc").isNull(), F.col("doc"), F.col("text_hash"))).alias("least"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("nodes").alias("nodes"))
    sets = sets.select("set_key", F.col("least.doc").alias("first_doc"), "least.text_hash", "n_copies", "n_shingles", "nodes")
    placed = sets.where("n_shingles > 0").select("set_key", "first_doc", "text_hash", "n_copies", "n_shingles", F.posexplode("nodes").alias("tree", "node"))
    shared = placed.groupBy("tree", "node").agg(
        F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"),
        F.bit_xor(F.xxhash64("set_key")).alias("mark"), F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("mark2"))
    shared = shared.where("members > 1").groupBy("members", "shingles", "mark", "mark2").agg(F.min(F.struct("tree", "node")).alias("at"))
    shared = shared.select("members", "shingles", "at.tree", "at.node")
    members = keep(placed.drop("n_shingles").join(shared, ["tree", "node"]))

    wanted = members.select("set_key", "first_doc", F.col("text_hash").alias("wanted_hash"), "n_copies").distinct()
    same = rows["doc"].eqNullSafe(wanted["first_doc"]) & (rows["text_hash"] == wanted["wanted_hash"])
    found = rows.join(wanted, same).select("text", "set_key", "n_copies")
    found = found.mapInArrow(_fetch(size, depth), "set_key binary, n_copies long, shingles binary, nodes binary").dropDuplicates(["set_key"])
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_key"), "blocks"))
    dealt = dealt.select("set_key", "tree", "node", "block", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    dealt = dealt.select("set_key", "tree", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    links = keep(dealt.join(found, "set_key").groupBy("tree", "node", "low", "high").applyInArrow(
        _verify(similarity), "set_key binary, hub binary, n_links long, n_texts long"))

    counts = links.groupBy("set_key").agg(F.sum("n_links").alias("n_links"), F.sum("n_texts").alias("n_texts"))
    labels = components(links.select(F.col("set_key").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("node", "set_key")
    linked = counts.join(labels, "set_key")
    merged = sets.select("set_key", "first_doc", "n_copies").join(linked, "set_key", "left").where("n_copies > 1 OR label IS NOT NULL")
    merged = merged.withColumn("label", F.coalesce("label", "set_key"))
    least = F.min(F.struct(F.col("first_doc").isNull(), "first_doc", F.col("set_key").alias("chosen_key"))).alias("least")
    first = merged.groupBy("label").agg(least).select("label", F.col("least.first_doc").alias("class_id"), "least.chosen_key")
    classes = merged.join(first, "label").select(
        "set_key", "label", "class_id", (F.coalesce("n_links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"), "n_copies", (F.col("set_key") == F.col("chosen_key")).alias("chosen"))
    return signed.select("doc", "set_key"), classes


def similar_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_texts and n_copies.

    A class is a connected part of the links; its id is the least document id in it. n_links counts the other
    documents at or above the similarity, copies included; n_texts the other text classes among them; n_copies the
    documents of the same set, itself included.
    """
    rows, classes = text_classes(documents, doc_id, text, **settings)
    out = rows.join(classes.drop("label"), "set_key", "left")
    return out.select(
        F.col("doc").alias("doc_id"), F.when(F.col("n_copies").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each_class(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows that stay when one document of each class is kept: the one with the least id. Columns stay."""
    size = settings.get("size", SIZE)
    _, classes = text_classes(documents, doc_id, text, **settings)
    key, place = free_name(documents, "set_key"), documents.columns.index(text)
    names = documents.columns

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, place):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sets(raw, size)[1], pa.binary())], names=[*names, key])

    schema = documents.limit(0).withColumn(key, F.lit(None).cast("binary")).schema
    keyed = documents.mapInArrow(with_key, schema)
    found = classes.select(F.col("set_key").alias(key), F.struct("class_id", "n_copies", "chosen").alias("_class_of"))
    mark = free_name(keyed, "class_of")
    joined = keyed.join(found.withColumnRenamed("_class_of", mark), key, "left")
    alone = F.col(mark).isNull()
    # Of a chosen set only copies share the class's id; other sets of the class may have it, too, and don't stay.
    chosen = F.col(mark)["chosen"] & F.col(doc_id).eqNullSafe(F.col(mark)["class_id"])
    single = joined.where(alone | (chosen & (F.col(mark)["n_copies"] == 1))).select(names)
    repeated = joined.where(~alone & chosen & (F.col(mark)["n_copies"] > 1))
    once = repeated.dropDuplicates([key]).select(names)
    return single.union(once)

