"""The operators' queries and frames against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from comparison import connect, duck_rows, spark_rows
from eventspark.llm import decontamination, interpolation, packing, quality_rules, sharding, tag_paths, token_files, tokens, toxicity, url_rules
from eventspark.llm.queries import llm_queries, llm_sql

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark, medium):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_equals_its_sql(spark, medium, name):
    assert spark_rows(llm_queries()[name](spark, medium)) == duck_rows(connect(medium), llm_sql()[name])


def odd(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(2)


# --- 1: language model


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]


def brute_model(rows):
    """rows of (key, text, trains) -> key: (n, known, N, base, score), weights by EM over exact deleted estimates."""
    docs = [(k, words(t), tr) for k, t, tr in rows]
    one, two, starts = Counter(), Counter(), 0
    for _, w, tr in docs:
        if tr:
            one.update(w)
            two.update(zip([None, *w], w))
            starts += 1
    total, different = sum(one.values()), len(one)
    seen = lambda u: starts if u is None else one[u]
    cells = {}
    for _, w, tr in docs:
        if tr:
            o, t = Counter(w), Counter(zip([None, *w], w))
            for u, x in zip([None, *w], w):
                c = seen(u) - (1 if u is None else o[u])
                f2 = (two[u, x] - t[u, x]) / c if c else 0.0
                f1 = (one[x] - o[x]) / (total - len(w)) if total > len(w) else 0.0
                cells.setdefault(c.bit_length(), []).append((f2, f1))
    weights = {}
    for b, f in cells.items():
        f = np.array([(*p, 1 / (different + 1)) for p in f])
        w = np.full(3, 1 / 3)
        for _ in range(interpolation.ROUNDS):
            share = f * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        weights[b] = w
    out = {}
    for k, w, _ in docs:
        base = sum(math.log10((one[x] + 0.5) / (total + 0.5 * (different + 1))) for x in w)
        score = 0.0
        for u, x in zip([None, *w], w):
            c = seen(u)
            b = min(weights, key=lambda i: (abs(i - c.bit_length()), i))
            a = weights[b]
            score += math.log10(a[0] * (two[u, x] / c if c else 0) + a[1] * one[x] / total + max(a[2], 1e-9) / (different + 1))
        out[k] = (len(w), sum(one[x] > 0 for x in w), total, base, score)
    return out


def test_scores_equal_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(interpolation, "CHUNK", 100_000)
    rows = [(k, t, k % 5 != 1) for k, t in texts.items() if k < 250] + [(1000, None, False), (1001, "", True), (None, "the the", None)]
    df = odd(spark, rows, "doc_id long, text string, keys boolean")
    got = {r.doc_id: r for r in interpolation.deleted_interpolation(df, F.col("keys")).collect()}
    want = brute_model([(k, t, tr is not False) for k, t, tr in rows])
    assert set(got) == set(want)
    for k, (n, known, total, base, score) in want.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=0.01)
    held = [k for k, t, tr in rows if tr is False]
    assert sum(got[k].score for k in held) > sum(got[k].base_score for k in held)


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert interpolation.deleted_interpolation(empty, F.lit(True)).count() == 0
    row = interpolation.deleted_interpolation(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)


# --- 2: shards


def jump_one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function_and_moves_little():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    for n in (1, 2, 24, 25):
        assert sharding.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert ((a == b) | (b == 24)).all() and 0.02 < (a != b).mean() < 0.06


def test_slots_are_gapless_with_repeats_and_nulls(spark, texts, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 40)
    rows = [(k, t) for k, t in texts.items()] + [(None, None)] * 50 + [(5, "x")] * 30 + [(None, "é")]
    got = sharding.shard_digest(odd(spark, rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    df = spark.createDataFrame([(1, 2)], "k int, shard int")
    placed, name = sharding.with_shard(df, "k", 24)
    assert name != "shard" and placed.columns == ["k", "shard", name]
    assert sharding.shard_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 3: quality


def test_figures_of_odd_texts(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "a b c d e f a b c d e x a b c d e", "en", "a"), (4, "x\nx\n \n\nx", "en", "a"),
            (5, "a\u00a0b c\td|#", None, "a"), (5, "a\u00a0b c\td|#", None, "a")]
    df = odd(spark, rows, "doc_id int, text string, lang string, source string").withColumn("x", F.lit(1))
    got = {r.doc_id: r for r in quality_rules.quality_digest(df).collect()}
    pick = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert pick(got[1]) == pick(got[2]) == (0, 0, 0, 0, 0) and got[1].base_failed and got[1].kept is False
    assert pick(got[3]) == (17, 17, 0, 0, 15) and got[3].base_failed
    assert pick(got[4]) == (3, 3, 0, 2, 0)
    assert pick(got[5]) == (3, 7, 2, 0, 0)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 0
    assert quality_rules.quality_digest(df.limit(0)).count() == 0


def test_half_of_a_source_may_be_junk(spark):
    clean = " ".join(f"word{k}" for k in range(40))
    junk = " ".join(f"w{k}###" for k in range(40))
    rows = [(k, clean + str(k), "en", "s") for k in range(120)] + [(1000 + k, junk + str(k), "en", "s") for k in range(100)]
    kept = {r.doc_id for r in quality_rules.keep_good(odd(spark, rows, "doc_id int, text string, lang string, source string")).collect()}
    assert kept == set(range(120))


def test_sketches_merge_to_the_same_table(spark, medium):
    df = spark.read.parquet(f"{medium}/documents.parquet")
    groups = df.select("lang", "source", quality_rules.figures_of(F.col("text")).alias("x"), "doc_id")
    whole = {tuple(r) for r in quality_rules.sketches(groups).collect()}
    halves = quality_rules.sketches(groups.where("doc_id % 2 = 0")).union(quality_rules.sketches(groups.where("doc_id % 2 = 1")))
    assert {tuple(r) for r in halves.groupBy("lang", "source", "rule", "bin").agg(F.sum("n")).collect()} == whole


# --- 4: benchmark


def test_small_blocks_spans_and_odd_rows(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven"
    bench = odd(spark, [(1, item), (2, "short item"), (2, "short item"), (3, None), (4, "?!"), (None, item)], "item_id long, text string")
    docs = [(1, f"Before. {item.upper()}, after", "a"), (2, "a Short, ITEM here", "b"), (3, None, None), (4, "", ""), (5, "clean text", "c"),
            (6, "one two three four five six seven eight nine", "d"), (7, "x " * 3000 + item, "e")]
    df = odd(spark, docs, "doc_id int, text string, overlap string")
    want = {1: (13, 11, 2), 2: (4, 2, 1), 3: (0, 0, 0), 4: (0, 0, 0), 5: (2, 0, 0), 6: (9, 0, 0), 7: (3011, 11, 2)}
    for limit in (1000, 1):
        got = {r.doc_id: r for r in decontamination.overlap_digest(df, bench, block_windows=limit).collect()}
        assert {k: (r.n_words, r.n_hit, r.n_items) for k, r in got.items()} == want
        assert got[1].items_sha256 == hashlib.sha256(b",1").hexdigest() and got[5].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(df, bench, remove="spans").collect()}
    assert cut == {1: "Before. , after", 2: "a  here", 3: None, 4: "", 5: "clean text", 6: docs[5][1], 7: "x " * 3000}
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0
    assert decontamination.decontaminate(df, bench.limit(0)).count() == len(docs)


# --- 5 and 9: token ids


@pytest.fixture(scope="module")
def whole_ids():
    library = Tokenizer.from_file(TOKENIZER)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(whole_ids):
    rng = np.random.default_rng(3)
    letters = list(" \n\t  aZ'sd.,é1!ñ日\u3000\u00a0\r\x00\u0301") + ["<|endoftext|>", "don't", " the", "\n\n", "  "]
    encode = tokens.Encoder(TOKENIZER)
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(0, 14)))
        assert encode.ids([text])[0].tolist() == whole_ids(text), repr(text)


@pytest.mark.parametrize("n,most", [(1, 1024), (40, 1024), (300, 256), (500, 40)])
def test_differencing_never_exceeds_and_is_near_equal(n, most):
    sizes = np.random.default_rng(n).integers(1, most + 1, n).tolist()
    found = packing.differencing(sizes)
    assert sorted(k for g in found for k in g) == list(range(n))
    loads = [sum(sizes[k] for k in g) for g in found]
    assert max(loads) <= 1024 and (n < 300 or max(loads) - min(loads) <= 64)


def check_pieces(rows, ids, with_ids=False):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        assert not with_ids or bytes(r.ids) == own.tobytes()
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[k])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(len(i) for i in ids.values()) / 1024 / len(by_sequence)


def test_packing_places_each_id_once(spark, medium, texts, whole_ids):
    ids = {k: [*whole_ids(t), 0] for k, t in texts.items()}
    assert check_pieces(llm_queries()["op5_packing"](spark, medium).collect(), ids) > 0.98


def test_packing_of_odd_rows(spark, whole_ids):
    rows = [(1, None), (2, ""), (3, "a " * 3000), (4, "  x  "), (None, "b")]
    pieces = packing.pack_documents(odd(spark, rows, "doc_id int, text string"), TOKENIZER, with_ids=True)
    kept = pieces.collect()
    check_pieces(kept, {k: [*whole_ids(t), 0] for k, t in rows}, with_ids=True)
    joined = packing.sequences(spark.createDataFrame(kept, pieces.schema)).collect()
    assert sum(len(r.ids) for r in joined) == 4 * sum(r.length for r in kept)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id int, text string"), TOKENIZER).count() == 0


def check_corpus(rows, order, ids):
    at = 0
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rows))
    assert [g[1] for g in got] == order
    for start, k, n, crc in got:
        assert start == at and n == len(ids[k]) and crc == zlib.crc32(np.array(ids[k], "<u4").tobytes())
        at += n


def test_token_files_round_trip(spark, medium, texts, whole_ids):
    ids = {k: [*whole_ids(t), 2] for k, t in texts.items()}
    check_corpus(llm_queries()["op9_token_files"](spark, medium).collect(), sorted(ids), ids)


def test_token_files_of_odd_rows(spark, whole_ids, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 2)
    rows = [(9, "nine"), (3, None), (5, ""), (None, "none"), (7, "long " * 5000), (1, "one")]
    path = str(tmp_path / "corpus")
    token_files.write_corpus(odd(spark, rows, "doc_id long, text string"), TOKENIZER, path)
    ids = {k: [*whole_ids(t), 2] for k, t in rows}
    check_corpus(token_files.read_corpus(spark, path).collect(), [None, 1, 3, 5, 7, 9], ids)
    assert [a.tolist() for a in token_files.read_document(spark, path, 7)] == [ids[7]]
    row = spark.read.parquet(f"{path}/dictionary").first()
    assert row.sha256 == hashlib.sha256(bytes(row.dictionary)).hexdigest()
    empty = str(tmp_path / "empty")
    token_files.write_corpus(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER, empty)
    assert token_files.read_corpus(spark, empty).count() == 0


# --- 6: toxicity


def test_toxicity_held_out(spark, medium):
    rows = llm_queries()["op6_toxicity"](spark, medium).join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert len(bad) > 4 and sum(b > g for b in bad for g in good) / (len(bad) * len(good)) > 0.85
    assert sum((r.score >= 0.5) == r.toxic for r in rows) / len(rows) > 0.92 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark):
    rows = [(k, f"you stupid idiot {k}" if k % 3 == 0 else f"a fine day number {k}", "x") for k in range(90)] + [(100, None, "x"), (101, "", "x"), (102, "IDIOT " * 20000, "x")]
    docs = odd(spark, rows, "doc_id int, text string, toxic_score string")
    labels = odd(spark, [(k, int(k % 3 == 0)) for k in range(90)] + [(None, 1), (5, None), (6, 7)], "doc_id int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_digest(docs, labels, F.col("doc_id") % 5 == 4).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[100] == got[101] < 0.5 < got[102]
    assert all((got[k] >= 0.5) == (k % 3 == 0) for k in range(90))
    left = toxicity.drop_toxic(docs, labels, F.lit(False))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k in range(90) if k % 3} | {100, 101}
    assert {r.score for r in toxicity.toxicity_digest(docs, labels.limit(0), F.lit(False)).collect()}.pop() < 1e-9
    assert toxicity.toxicity_digest(docs.limit(0), labels, F.lit(False)).count() == 0


def test_rows_of_one_id_are_bounded_and_take_turns(spark, monkeypatch):
    rows = [(0, f"a fine day number {k}") for k in range(300)] + [(k, f"you stupid idiot {k}" if k % 2 else f"good morning {k}") for k in range(1, 41)] * 3
    labels = odd(spark, [(k, k % 2) for k in range(41)], "doc_id int, toxic int")
    seen, fit = [], toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda rows, ratio: seen.append(rows) or fit(rows, ratio))
    docs = odd(spark, rows, "doc_id int, text string")
    for limit, n, toxic in ((50, 50, 15), (1000, 340, 20)):
        toxicity.train(docs, labels, F.lit(True), limit=limit)
        got = seen.pop()
        assert len(got) == n and toxic <= sum(label for label, _ in got) <= 20


# --- 7: main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header class="site">Site, name</header>
<div id="cookie-notice"><p>We use cookies. Please, agree to all of them now.</p></div><ul class="menu"><li><a href=/>Home</a><li>News</ul>
<div class="page"><article><h1>Title</h1><p><b>First, with &amp; and &lt;tag&gt;.<br>Same block.<p>Second   one,
on two lines.</p><ul><li>Item<li>Other</ul><form><p>Your mail, please.</p></form><div class="ad-box">Buy, now. Really.</div>
<section class="comments"><p>I like this, very much. Thank you, dear author.</p></section></article>
<aside><p>Aside, long enough to be read. It is a paragraph.</p></aside></div><footer>&copy; me<!-- x --></footer></body></html>"""


def test_extraction():
    assert tag_paths.extract(PAGE) == "Title\n\nFirst, with & and <tag>. Same block.\n\nSecond one, on two lines.\n\nItem\n\nOther"
    assert tag_paths.extract(PAGE[: PAGE.index("<form>")]).endswith("Other")
    for page in (None, "", "<p>", "<script>x", "<!-- ", "<a href='x", "<div class=ad>x</div>"):
        assert tag_paths.extract(page) == "", page
    assert tag_paths.extract("plain &eacute;") == "plain é"
    plain = "<div><div><a>a</a> <a>b</a></div><div class=x><p>%s</p><p>Short.</p></div><div>end</div></div>" % ("Some words, and more. " * 20)
    assert tag_paths.extract(plain).startswith("Some words") and tag_paths.extract(plain).endswith("Short.")


LONG = "Some words, and more. " * 20


@pytest.mark.parametrize("inner", [
    f"<section><p>{LONG * 2}</p></section><section><p>{LONG}</p></section>",
    f"<h1>Title</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div>",
    *(f"<p>intro</p><{x}>{LONG}</{x}><p>end</p>" for x in ("blockquote", "pre")),
    f"<p>intro</p><ul><li>{LONG}<li>{LONG}</ul><p>end</p>", f"<p>intro</p><table><tr><td>{LONG}<td>{LONG}</table><p>end</p>",
    f"<section><h2>One</h2><p>{LONG * 2}</p></section><section><h2>Two</h2><p>{LONG}</p></section>"])
def test_extraction_keeps_whole_articles(inner):
    want = [" ".join(t.split()) for t in re.findall("[^<>]+(?=<)", re.sub("<[^>]*>", "<>", inner) + "<")]
    for page in ("<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>"):
        assert tag_paths.extract(f"<body><ul><li><a href=/>Home</a></ul>{page % inner}<div><a href=/>Next</a></div></body>").split("\n\n") == want, page


def test_extraction_drops_no_block_of_a_content_path():
    post = f"<section><h2>One</h2><p>{LONG * 2}</p></section><section><h2>Two</h2><p>{LONG}</p></section>"
    want = ["One", (LONG * 2).strip(), "Two", LONG.strip()]
    assert tag_paths.extract(f"<body><p><a href=/>Home</a></p><div>{post}</div></body>").split("\n\n") == want
    assert tag_paths.extract(post).split("\n\n") == want
    both = tag_paths.extract(f"<article><h1>T</h1><p>{LONG * 2}</p></article><div><a href=/>x</a></div><section><p>{LONG}</p></section>")
    assert both.split("\n\n") == ["T", (LONG * 2).strip(), LONG.strip()]


@pytest.mark.parametrize("wrapper", [
    'class="content has-sidebar"', "class=with-sidebar", "class=no-sidebar", "class=ad-free", 'class="site nav-open"', 'id="post-notice-1"',
    "class=left-sidebar", "class=page-with-ads", "class='page comments-open'", "class=header"])
def test_extraction_keeps_wrappers_named_like_menus(wrapper):
    body = f"<h1>Title</h1><p>{LONG}</p><section class=comments><p>{LONG * 3}</p></section><div class=sidebar><p>Aside, aside.</p></div>"
    want = ["Title", LONG.strip()]
    links = "<ul><li><a href=/>Home</a></ul>"
    for page in (f"<div {wrapper}><article>{body}</article></div>", f"<div {wrapper}>{links}<main>{body}</main></div><div class=ad>{LONG * 5}</div>"):
        assert tag_paths.extract(f"<body>{page}</body>").split("\n\n") == want, page
    assert tag_paths.extract(f"<body><div {wrapper}><h1>Title</h1><p>{LONG}</p></div></body>").split("\n\n") == want


def test_extraction_compares_what_is_dropped():
    post = f"<article><p>{LONG}</p></article>"
    for other in ("id=comments", "class=related-posts", "class=ad-slot", "class=cookie-consent"):
        assert tag_paths.extract(f"<main>{post}</main><div {other}><article><p>{LONG * 3}</p></article></div>") == LONG.strip(), other
    widgets = "".join(f"<div class=elementor-widget><p>{k} {LONG}</p></div>" for k in range(5))
    assert tag_paths.extract(f"<body>{widgets}</body>").count("Some words") == 100
    assert tag_paths.extract(f"<body>{widgets[:600]}</div>{post * 3}</body>").startswith("Some words")
    assert tag_paths.extract(f"<p>{LONG}<span class=ad>Buy it.</span> End.</p>") == f"{LONG}End."


def test_extraction_of_the_table(spark, medium):
    rows = {r.page_id: r for r in llm_queries()["op7_tag_paths"](spark, medium).collect()}
    pages = spark.read.parquet(f"{medium}/pages.parquet").collect()
    assert set(rows) == {p.page_id for p in pages}
    for p in pages:
        r = rows[p.page_id]
        assert r.n_chars == len(r.text) > 0 and "<" not in re.sub(r"<\W|<$", "", r.text)
        first = re.search(r"<h1>([^<]*)</h1>", p.html)
        assert first is None or r.text.startswith(" ".join(first[1].replace("&amp;", "&").split())[:20])
    df = odd(spark, [(1, None, "<p>a"), (None, "u", None)], "page_id int, main_text string, html string")
    found, name = tag_paths.with_main_text(df)
    assert sorted(r[name] for r in found.collect()) == ["", "a"]


# --- 8: URLs


def brute_host(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_urls_of_the_table_and_odd_ones(spark, medium):
    odd_urls = [None, "", "x", "http://", "HTTP://A.Example.ORG/es/1", "http://example.org", "http://example.org/", "a://notexample.org/en/1", "http://org/",
                "http://x.com/de/9?x=://b/fr/", "ftp://Ä.com/fr/#a", "http://u:p@h.com:80/de/1", "x://b.com\n/fr/\n1", "http://example.org/en/123"]
    pages = spark.read.parquet(f"{medium}/pages.parquet").select("page_id", "url").union(odd(spark, [(10_000 + k, u) for k, u in enumerate(odd_urls)], "page_id long, url string"))
    given = {r.page_id: r.url for r in pages.collect()}
    got = {r.page_id: r for r in url_rules.url_digest(pages).collect()}
    assert set(got) == set(given)
    for k, url in given.items():
        r, (host, path) = got[k], brute_host(url)
        fits = [(len(h + p), h + p, v) for h, p, v in url_rules.FIXED_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None), url
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}


def test_mined_rules_against_counting(spark):
    urls = [f"http://a{k}.example.com/de/{k}" for k in range(30)] + [f"http://b{k}.example.com/fr/{k}" for k in range(30)] + ["http://c.net/de/1", "http://c.net/fr/1", "http://c.net/xx/1"]
    rows = url_rules.judge(odd(spark, [(u, k) for k, u in enumerate(urls)], "url string, judged int"))
    got = {r.url: r.judged_ for r in rows.collect()}
    assert rows.columns == ["url", "judged", "judged_"]
    assert [got[u].verdict for u in urls[-3:]] == ["block", "allow", "allow"]
    assert url_rules.url_digest(spark.createDataFrame([], "page_id int, url string")).count() == 0


# --- pipeline


def test_pipeline_stages_keep_columns_and_clean_rows(spark, medium):
    import corpus_pipeline

    docs = spark.read.parquet(f"{medium}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, medium)
        assert left.columns == docs.columns, name
        rows = left.collect()
        left = spark.createDataFrame(rows, docs.schema)
    ids = {r.doc_id for r in rows}
    assert 500 < len(ids) == len(rows)
    dirty = {r.doc_id for r in llm_queries()["op4_decontamination"](spark, medium).where("contaminated").collect()}
    assert not ids & dirty
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, medium)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "benchmark", "packing"]


def test_pipeline_equals_brute_force(spark, small, whole_ids):
    import corpus_pipeline
    from test_jaccard_forest import brute

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    toxic = {r.doc_id for r in llm_queries()["op6_toxicity"](spark, small).where("predicted = 1").collect()}
    calm = set(docs) - toxic
    duck = connect(small)
    table = f"read_parquet('{small}/documents.parquet') WHERE doc_id IN ({','.join(map(str, calm))})"
    duck.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM {table}")
    good = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({llm_sql()['op3_quality_rules']}) WHERE kept").fetchall()}
    firsts = {k for k, (first, *_) in brute([(k, docs[k]) for k in good]).items() if k == first}
    dirty = {r[0] for r in connect(small).execute(f"SELECT doc_id FROM ({llm_sql()['op4_decontamination']}) WHERE contaminated").fetchall()}
    assert toxic and calm - good and good - firsts and firsts & dirty and firsts - dirty
    check_pieces(corpus_pipeline.run(spark, small).collect(), {k: [*whole_ids(docs[k]), 0] for k in firsts - dirty})
