"""Mined URL rules against counting, deep pages, link lists, labels of absent documents, and rows repeated in blocks."""

import itertools
import random
import time
import tracemalloc
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventspark.llm import frames, sharding, tag_paths, toxicity, url_rules
from eventspark.llm.frames import repeated
from eventspark.llm.tokens import Encoder, _Memo, portions


def brute_rules(rows, support, confidence):
    """rows of (tokens, label): {(items, label): (confidence, support)}, without rules that a part makes needless."""
    n, every, both = len(rows), Counter(), Counter()
    for tokens, label in rows:
        for size in (1, 2, 3):
            for items in itertools.combinations(sorted(set(tokens)), size):
                every[items] += 1
                both[items, label] += 1
    rules = {k: (c / every[k[0]], c / n) for k, c in both.items() if c >= support * n and c / every[k[0]] >= confidence}
    parts = lambda items: (p for size in range(1, len(items)) for p in itertools.combinations(items, size))
    return {(i, v): r for (i, v), r in rules.items() if not any((p, v) in rules and rules[p, v][0] >= r[0] for p in parts(i))}


def sets(spark, rows):
    frame = spark.createDataFrame([(sorted(set(t)), v) for t, v in rows], "tokens array<string>, label string")
    return frame.groupBy("tokens", "label").agg(F.count("*").alias("n"))


@pytest.mark.parametrize("most", [16, 2])
def test_mined_rules_equal_counting(spark, most):
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        tokens = [t for t in "abcdefg" if rng.random() < 0.4]
        rows.append((tokens, "block" if ("a" in tokens and "b" in tokens) or rng.random() < 0.2 else "allow"))
    got = url_rules.mine(sets(spark, rows), 0.02, 0.7, most=most).collect()
    want = brute_rules(rows, 0.02, 0.7)
    assert {(tuple(r["items"]), r.verdict) for r in got} == set(want) and len(want) >= 5
    for r in got:
        assert (r.confidence, r.support) == pytest.approx(want[tuple(r["items"]), r.verdict])


def judged(spark, urls):
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    return {r.page_id: r for r in url_rules.url_digest(frame).collect()}


def test_verdicts_of_shared_segments_are_quick_and_hold_for_each(spark):
    deep = "/".join(f"part{k}" for k in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN")
    urls = [f"https://a.example.org/es/{deep}/{k}" for k in range(60)] + [f"https://b.org/en/{k}" for k in range(60)]
    urls += ["https://c.net/es/x", "https://c.net/fr/parta", f"https://c.net/xx/{deep}", "https://c.net/en/zz"]
    begun = time.time()
    got = judged(spark, urls)
    assert time.time() - begun < 60
    assert [got[k].verdict for k in (0, 59, 60, 119)] == ["block", "block", "allow", "allow"]
    # One token of the template is enough; a path of another depth is another token.
    assert [got[k].verdict for k in range(120, 124)] == ["block", "block", "block", "allow"]


def test_nested_paths_are_counted(spark):
    names = [f"d{chr(97 + k)}" for k in range(24)]
    urls = [f"https://x.example.org/es/{'/'.join(names[: 1 + k % 24])}" for k in range(480)] + [f"https://y.org/{k}" for k in range(40)]
    got = judged(spark, [*urls, "https://z.net/es/da/db"])
    assert got[520].verdict == "block" and got[519].verdict == "allow"


def test_repeated_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(frames, "REPEAT", 7)
    frame = spark.createDataFrame([("a", 20), ("b", 1), ("c", 0), ("d", 7), ("e", None)], "k string, n long")
    got = sorted((r.k, r.i) for r in repeated(frame, "n", "i").collect())
    assert got == [("a", i) for i in range(20)] + [("b", 0)] + [("d", i) for i in range(7)]
    rows = spark.range(100).select(F.lit(5).alias("doc_id"), F.lit("same").alias("text"))
    placed = sharding.shard_digest(rows).collect()
    assert sorted(r.slot for r in placed) == list(range(100)) and len({r.shard for r in placed}) == 1


@pytest.mark.parametrize("page", [
    "<div>x " * 200_000, "<div class=sidebar>x " * 100_000, "<b><div>x</div>" * 100_000, "<div>" * 100_000 + "</section>" * 100_000,
    "<div>" * 100_000 + "<li>x" * 100_000, "<b><div>" + "<i>" * 100_000 + "</b>x" * 100_000, "<article class=ad>x" * 100_000, "<p>x<b>" * 100_000,
], ids=["div", "sidebar", "inline", "unknown end", "li", "inline end", "article", "p"])
def test_time_grows_with_length_not_depth(page):
    begun = time.time()
    tag_paths.extract(page)
    assert time.time() - begun < 40


PROSE = "The committee met again on Tuesday, and after a long debate, it agreed on the plan; nobody objected. "
LINKED = f"""<html><body><article><h1>News</h1><p>{PROSE * 3}</p><ul><li><a href=1>link one</a></li><li><a href=2>link two</a></li></ul>
<p>{PROSE * 2}</p><ul><li>first point</li><li>second point</li></ul><div><a href=3>Read next: another story</a></div>
<div class="discussion"><p>{PROSE}</p></div></article></body></html>"""


def test_lists_of_links_and_discussions_in_an_article_go(monkeypatch):
    want = ["News", (PROSE * 3).strip(), (PROSE * 2).strip(), "first point", "second point"]
    page = LINKED.replace("<ul><li>first point</li><li>second point</li></ul>", "<ol><li>first point</li><li>second point</li></ol>")
    assert tag_paths.extract(page).split("\n\n") == want
    # With every path declared content the ratios decide nothing, and the lists stay.
    monkeypatch.setattr(tag_paths, "SHARE", 0.0)
    monkeypatch.setattr(tag_paths, "OWN", 0.0)
    assert "link one" in tag_paths.extract(page) and "Read next: another story" in tag_paths.extract(page)


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k, "you vile filthy idiot scum" if k % 2 else "a calm and friendly remark") for k in range(40)], "doc_id long, text string")
    labels = spark.range(5000).select((F.col("id") - 4960).alias("doc_id"), F.pmod("id", F.lit(2)).alias("toxic"))
    model = toxicity.train(docs, labels, F.lit(True), limit=50)
    scored, name = toxicity.with_score(docs, model)
    assert all((r[name] >= 0.5) == (r.doc_id % 2 == 1) for r in scored.collect())
    with pytest.warns(UserWarning, match="every score is the same"):
        toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))


def test_limits_follow_the_group(spark, medium):
    """What is usual in one source is rejected in another; most limits come from the sketches' spread."""
    from eventspark.llm import quality_rules as Q

    rng = random.Random(3)
    text = lambda n, spread: " ".join("x" * max(1, round(rng.gauss(n, spread))) + chr(97 + rng.randrange(26)) for _ in range(60))
    rows = [(k, text(5 + rng.random(), 1), "en", "narrow") for k in range(150)] + [(200 + k, text(4 + 12 * rng.random(), 2), "en", "wide") for k in range(150)]
    rows += [(900, text(13, 1), "en", "narrow"), (901, text(13, 1), "en", "wide")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in Q.quality_digest(docs).where("kept").collect()}
    assert 900 not in kept and 901 in kept and len(kept) >= 299
    groups = spark.read.parquet(f"{medium}/documents.parquet").select("lang", "source", Q.figures_of(F.col("text")).alias("x"))
    sketch = Q.sketches(groups).persist()
    limits = Q._limits(sketch, ["lang"]).collect()
    medians = {(r.lang, r.rule): r.m for r in sketch.groupBy("lang", "rule").agg(F.percentile("bin", F.lit(0.5), F.col("n")).alias("m")).collect()}
    own = [r[f"high_{rule}"] > medians[r.lang, rule] + (Q.LEAST.get(rule) or medians[r.lang, rule] / Q.LEAST_SHARE) + 1 for r in limits for rule in Q.RULES if rule != "symbols"]
    assert sum(own) > 0.7 * len(own)


def test_what_a_worker_keeps_of_pieces_and_holds_of_features_is_bounded():
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnop", repeat=5), 700_000)]
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"), corpus_pipeline.MEMO_PIECES)
    for at in range(0, len(words), 1000):
        encode.ids([" ".join(words[at : at + 1000])])
    assert len(encode.young) + len(encode.old) < 610_000
    texts = [" ".join(words[at : at + 500]) for at in range(0, 180_000, 500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 2 for k in range(len(texts))])], ["text", "label"])
    tracemalloc.start()
    list(toxicity._count([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20


def test_pieces_of_a_call_are_looked_up_once_and_words_learned_without_signs(monkeypatch):
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = lambda text: encode.tokenizer.encode(text or "", add_special_tokens=False).ids
    asked = []
    monkeypatch.setattr(_Memo, "__getitem__", lambda memo, piece: asked.append(piece) or dict.__getitem__(memo, piece), raising=False)
    texts = ["the very same words"] * 300 + [None, ""] + ["the very same words, again"] * 300
    assert [ids.tolist() for ids in encode.ids(texts)] == [whole(t) for t in texts]
    assert sorted(asked) == sorted(["the", " very", " same", " words", ",", " again"])
    words = ["".join(w) for w in itertools.product("abcé", repeat=5)]
    texts = [" ".join(w + sign for w in words) for sign in (".", ",", "!", "'s", ")", '"', "×.", "…")]
    assert [ids.tolist() for ids in encode.ids(texts)] == [whole(t) for t in texts]
    assert sum(set(piece.strip()) <= set("abcé.,!'s)\"") for piece in encode.young) < 2 * len(words) + 50


def test_portions_of_a_column_are_bounded_and_whole():
    texts = [None, "", "é" * 40, "ab", None, "c" * 9, "d", "e" * 30, "f"]
    column = pa.array(["cut off", *texts]).slice(1)
    parts = list(portions(column, 20))
    assert [t for _, part in parts for t in part] == texts
    assert [at for at, _ in parts] == [0, 3, 8] and list(portions(pa.nulls(2))) == [(0, [None, None])] and not list(portions(pa.array([], pa.string())))
