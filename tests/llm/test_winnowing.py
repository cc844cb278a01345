"""Fingerprints against the definition, the guarantee for shared passages, and the query against the whole small table."""

import hashlib
import random
import re

import numpy as np
import pytest

from eventspark.llm import winnowing
from eventspark.llm.queries import llm_queries
from eventspark.llm.winnowing import fingerprint_digest, fingerprints, unpack, winnow


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "").translate({c: c + 32 for c in range(65, 91)})


def slow(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    """Positions by the definition, the hash of a gram being that of the gram as a text."""
    code = plain(text)
    if not code:
        return []
    gram = min(gram, len(code))
    h = [int(winnow(code[i : i + gram], gram)[0][0]) for i in range(len(code) - gram + 1)]
    found = set()
    for a in range(max(1, len(h) - window + 1)):
        part = h[a : a + window]
        found.add(a + max(i for i, x in enumerate(part) if x == min(part)))
    return [(h[i], i) for i in sorted(found)]


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_definition():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("ab cD\né") for _ in range(rng.randint(0, 120)))
        for gram, window in ((3, 4), (5, 8), (20, 16)):
            h, at = winnow(text, gram, window)
            assert list(zip(h.tolist(), at.tolist(), strict=True)) == slow(text, gram, window)


def test_long_texts_in_steps(monkeypatch):
    text = "".join(random.Random(1).choices("abcdef gh", k=5000))
    want = winnow(text)
    monkeypatch.setattr(winnowing, "STEP", 500)
    assert all((a == b).all() for a, b in zip(winnow(text), want, strict=True))


def test_shared_passages_meet():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(50):
        shared = "".join(rng.choices(letters, k=winnowing.GRAM + winnowing.WINDOW - 1))
        a, b = ("".join(rng.choices(letters, k=200)) + shared + "".join(rng.choices(letters, k=100)) for _ in range(2))
        assert np.intersect1d(winnow(a)[0], winnow(b)[0]).size
        assert not np.intersect1d(winnow(a[:200])[0], winnow(b[:200])[0]).size


def want(rows):
    """The contract's figures, rows in order."""
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, changed = slow(text), slow(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, slow(after))))
    return out


def got(frame):
    read = lambda s: [(int(h), int(p)) for h, p in zip(*unpack(s), strict=True)]
    return [(r.doc_id, r.n_chars, r.edited_sha256, read(r.fingerprint), read(r.edited_fingerprint), r.near_edited, r.near_next) for r in frame.collect()]


def test_query_on_the_whole_table(spark, medium):
    rows = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = {r[0]: r for r in got(llm_queries()["op13_winnowing"](spark, medium))}
    assert len(found) == len(rows) == 1000
    texts = {r.doc_id: r.text for r in rows}
    for k, r in enumerate(rows):
        after = rows[(k + 1) % len(rows)].text
        cut = len(r.text) // 4
        assert found[r.doc_id][2] == hashlib.sha256((r.text[: len(r.text) - cut] + after[:cut]).encode()).hexdigest()
    short = [k for k in range(len(rows)) if len(rows[k].text) < 600][:100]
    for k in short:
        pair = want([tuple(rows[k]), tuple(rows[(k + 1) % len(rows)])])[0]
        assert found[rows[k].doc_id] == pair
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, found[i][3]) == found[i][3]
    long = [r for r in found.values() if r[1] > 500]
    assert 0.5 < sum(r[5] for r in long) / len(long) < 0.75
    assert sum(r[6] < r[5] for r in long) > 0.98 * len(long)


def test_odd_rows_and_ties(spark):
    far = "x y" * 30_000
    rows = [(None, None), (None, "two nulls"), (1, ""), (2, "A a"), (2, "A a"), (2, "A a"), (3, far), (4, " \n"), (5, "the end " * 9), (2**62 + 1, "p" * 50), (2**62, "q" * 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashed = {r.text: r.h for r in frame.selectExpr("coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""]))
    result = got(fingerprint_digest(frame))
    small = lambda rs: sorted((r for r in rs if r[1] < 1000), key=repr)
    ordered = [(i, t if t != far else far[:900]) for i, t in order]
    assert [r[:3] for r in sorted(result, key=repr)] == [r[:3] for r in sorted(_heads(order), key=repr)]
    assert [r for r in small(result) if r[0] != 2 and r[0] is not None] == [
        r for r in small(want(ordered)) if r[0] not in (2, 3) and r[0] is not None and r[1] < 900]
    one = got(fingerprint_digest(frame.where("doc_id = 5")))
    assert one == want([(5, "the end " * 9)]) and one[0][6] == 1.0
    assert fingerprint_digest(frame.limit(0)).count() == 0


def _heads(order):
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    return out


def test_equal_rows_fill_several_ranges(spark):
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, id, 7) doc_id", "if(id % 2 = 0, concat('t', id), 'the same text in many rows') text")
    result = fingerprint_digest(rows).groupBy("doc_id", "edited_sha256").count().collect()
    assert sum(r["count"] for r in result) == 4000
    assert sorted(r["count"] for r in result if r.doc_id == 7) == [1, 1999]


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "abc", "z")], "Fingerprints int, text string, hash string")
    frame, name = fingerprints(df)
    row = frame.first()
    assert name == "fingerprints_" and row.hash == "z" and [x.position for x in row[name]] == [0]
    with pytest.raises(ValueError):
        fingerprints(df, window=12)
