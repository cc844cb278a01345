"""The Jaccard join against comparing every two documents."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventspark.llm import jaccard_forest as forest


def shingles(text, size=5):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute(rows, similarity=0.8):
    """doc_id -> (class_id, n_links, n_texts, n_copies) for rows with different ids."""
    sets = [(d, None if t is None else shingles(t)) for d, t in rows]
    copies = Counter(s for _, s in sets if s is not None)
    texts = list(copies)
    near = {t: set() for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if a and b and len(a & b) >= similarity * len(a | b):
                near[a].add(b)
                near[b].add(a)
    part = {}
    for t in texts:
        if t not in part:
            todo, part[t] = [t], t
            while todo:
                for n in near[todo.pop()]:
                    if n not in part:
                        part[n] = t
                        todo.append(n)
    least = {}
    for d, s in sets:
        if s is not None and d is not None:
            least[part[s]] = min(d, least.get(part[s], d))
    return {
        d: (d, 0, 0, 1) if s is None else
        (least.get(part[s]), copies[s] - 1 + sum(copies[n] for n in near[s]), len(near[s]), copies[s])
        for d, s in sets
    }


def found(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_texts, r.n_copies) for r in df.collect()}


@pytest.fixture(scope="module")
def base(spark, medium):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]


def test_whole_table_equals_brute_force(spark, medium, base):
    got = found(forest.similar_documents(spark.read.parquet(f"{medium}/documents.parquet")))
    want = brute(base)
    assert got == want
    assert any(v[2] for v in want.values()) and any(v[3] > 1 for v in want.values())


def edited(text, k):
    words = text.split(" ")
    words[(k * 37) % len(words)] = f"word{k}"
    return " ".join(words)


def test_large_group_in_small_blocks_loses_no_link(spark, base, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_MEMBERS", 7)
    text = max((t for _, t in base[:50]), key=len)[:6000]
    rows = [(k, edited(text, k)) for k in range(60)] + [(100 + k, base[k][1]) for k in range(20)] + [(200, text), (201, text)]
    got = found(forest.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == brute(rows)


def test_nulls_empty_repeats_and_clashing_names(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n", 9), (4, "one two", 9), (5, "ONE two", 9), (None, "one two", 9), (7, None, 9),
            (8, "a b c d e f g", 9), (8, "a b c d e f g", 9), (8, "another text of some more words", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, set_key long")
    got = sorted(map(tuple, forest.similar_documents(df).collect()), key=repr)
    assert got == sorted([
        (1, 1, 0, 0, 1), (7, 7, 0, 0, 1), (2, 2, 1, 0, 2), (3, 2, 1, 0, 2), (4, 4, 2, 0, 3), (5, 4, 2, 0, 3), (None, 4, 2, 0, 3),
        (8, 8, 1, 0, 2), (8, 8, 1, 0, 2), (8, 8, 0, 0, 1)], key=repr)
    kept = sorted(map(tuple, forest.one_of_each_class(df).collect()), key=repr)
    assert kept == sorted([rows[0], rows[1], rows[3], rows[6], rows[7], rows[9]], key=repr)
    assert forest.similar_documents(df.limit(0)).count() == 0
    assert forest.one_of_each_class(df.limit(0)).columns == df.columns


def test_one_near_copy_of_equal_and_of_null_ids_stays(spark, base):
    text = max((t for _, t in base[:50]), key=len)[:3000]
    other, third = (" ".join(text.split(" ")[::k]) for k in (-1, 3))
    rows = [(8, text, 1), (8, edited(text, 1), 2), *[(None, edited(other, k), 3) for k in range(6)], (9, third, 4), (9, third, 5), (9, edited(third, 1), 6),
            (None, edited(third, 2), 7), (3, base[60][1], 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = forest.one_of_each_class(df).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 8, 9] and all(tuple(r) in rows for r in kept)
    assert [r.n for r in kept if r.doc_id is None] == [3]


def test_sets_of_one_id_meet_their_own_rows_only(spark, base, monkeypatch):
    real, read = forest._fetch, spark.sparkContext.accumulator(0)

    def counted(*settings):
        fetch = real(*settings)

        def run(batches):
            def each():
                for batch in batches:
                    read.add(batch.num_rows)
                    yield batch

            return fetch(each())

        return run

    monkeypatch.setattr(forest, "_fetch", counted)
    rows = [(None if k % 2 else 7, f"{edited(base[k][1], v)} {k}") for k in range(40) for v in (1, 2)]
    kept = forest.text_classes(spark.createDataFrame(rows, "doc_id long, text string"))[1].where("n_texts > 0").count()
    assert 20 < kept <= 80 and kept <= read.value <= 3 * len(rows)  # a retried or repeated task counts again


def test_prefix_is_shortened_to_the_target():
    depth = forest.prefix_depth(0.8, 0.9999)
    assert forest.expected_recall(0.8, depth) >= 0.9999 > forest.expected_recall(0.8, depth + 1)
    assert forest.prefix_depth(0.8, 0.5) > depth


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in forest.components(edges).collect()} == {0}
