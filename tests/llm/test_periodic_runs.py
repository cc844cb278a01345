"""Runs against a direct search by period, and the query against the whole small table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from eventspark.llm.periodic_runs import find_runs, runs_of
from eventspark.llm.queries import llm_queries


def brute(words, least=12):
    """All (start, length, period): stretches equal to themselves moved by the period, the least period of each."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 6])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 5 and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, n // 2)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        sizes = [len(w) for w in texts]
        key = np.array([x + 10 * d for d, w in enumerate(texts) for x in w], np.int64)
        end = np.repeat(np.cumsum(sizes), sizes)
        least = rng.choice([2, 5, 12])
        want = [(s + o, n, q) for w, o in zip(texts, np.cumsum(sizes) - sizes) for s, n, q in brute(w, least)]
        assert runs_of(key, end, least) == want


@pytest.mark.parametrize("period", [1, 2, 999, 30_000])
def test_a_long_run(period):
    n = 60_000
    base = np.random.default_rng(0).permutation(n) if period > 2 else np.arange(n)
    assert runs_of(base[np.arange(n) % period].astype(np.int64), np.full(n, n)) == [(0, n, period)]


def planted(doc_id, text):
    """The words of the contract and the runs' digest."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_query_equals_brute_force(spark, medium):
    rows = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").where("length(text) < 9000").collect()
    got = {r.doc_id: tuple(r) for r in llm_queries()["op11_periodic_runs"](spark, medium).collect()}
    assert len(got) == 1000
    assert {r.doc_id: got[r.doc_id] for r in rows} == {r.doc_id: digest(r.doc_id, r.text) for r in rows}
    assert sum(r[1] > 0 for r in got.values()) > 80


def test_odd_rows(spark, tmp_path):
    loop = " ".join(["on and on"] * 400)
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \n "), (4, "one"), (5, loop), (5, loop), (6, "é ü " * 9 + "end"), (7, "x" * 100_000), (8, "  " * 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, llm_queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((digest(*r) for r in rows), key=repr)
    none = tmp_path / "none"
    df.limit(0).write.parquet(f"{none}/documents.parquet")
    assert llm_queries()["op11_periodic_runs"](spark, str(none)).count() == 0


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, [2], "a b c d e f a b c d e f g", "z")], "Runs int, collapsed array<int>, text string, text_ string")
    found, runs, collapsed = find_runs(df)
    assert (runs, collapsed) == ("runs_", "collapsed_")
    row = found.first()
    assert row.Runs == 1 and row.collapsed == [2] and row[runs][0].period == 6 and row[collapsed] == "a b c d e f g"
