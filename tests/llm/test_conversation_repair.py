"""Repairs against a direct search over all edits, in one range and cut over many, and the query on the whole table."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspark.llm import conversation_repair as cr
from eventspark.llm.queries import llm_queries

SPACE = "\x20\x09-\x0D"


def best(rows):
    """(cost, letters, repaired rows): least cost, then ASCII-least letters; rows are (role, text, fault)."""

    @lru_cache(maxsize=None)
    def go(i, state):
        due = "ua"[state == "u"]
        name = {"u": "user", "a": "assistant"}[due]
        options = []
        if i == len(rows):
            if state in "0a":
                options.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            late = 5 * (fault == "truncated")
            c, s, out = go(i + 1, state)
            options.append((c + 2, "D" + s, out))
            if fault not in ("blank", "duplicate"):
                if role[:1] == due or (role[:1] == "s" and state == "0"):
                    c, s, out = go(i + 1, role[:1])
                    options.append((c + late, "K" + s, ((role, text), *out)))
                c, s, out = go(i + 1, due)
                options.append((c + 1 + late, "R" + s, ((name, text), *out)))
        c, s, out = inserted(i, due)
        options.append((c + 5, "I" + s, ((name, ""), *out)))
        return min(options, key=lambda o: o[:2])

    @lru_cache(maxsize=None)
    def inserted(i, state):
        """After an insert at most one more is ever useful at the same place."""
        due = "ua"[state == "u"]
        options = []
        if i == len(rows):
            if state == "a":
                options.append((0, "", ()))
            else:
                options.append((5, "I", (("assistant", ""),)))
        else:
            role, text, fault = rows[i]
            late = 5 * (fault == "truncated")
            c, s, out = go(i + 1, state)
            options.append((c + 2, "D" + s, out))
            if fault not in ("blank", "duplicate"):
                name = {"u": "user", "a": "assistant"}[due]
                if role[:1] == due:
                    c, s, out = go(i + 1, due)
                    options.append((c + late, "K" + s, ((role, text), *out)))
                c, s, out = go(i + 1, due)
                options.append((c + 1 + late, "R" + s, ((name, text), *out)))
        return min(options, key=lambda o: o[:2])

    return go(0, "0")


def fault(role, text, seen):
    if not re.search(f"[^{SPACE}]", text):
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "truncated" if re.sub(f"[{SPACE}]+$", "", text)[-1] not in ".!?" else ""


def brute(original, damage=True):
    """The contract over (conv, turn, role, text) rows whose turns differ within a conversation."""
    said = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for conv, turn, role, text in original:
        by[conv]
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20 if damage else 9
        if fate == 0:
            continue
        role, text = said(role), said(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        by[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, judged = set(), []
        for _, role, text in rows:
            judged.append((role, text, fault(role, text, seen)))
            seen.add((role, text))
        count = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        initials = [r[:1] for r, _, _ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = best(judged)
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    return sorted(map(tuple, frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def test_tables_equal_search():
    rng = random.Random(4)
    names = ["system", "user", "assistant", "tool"]
    for _ in range(1500):
        symbols = np.array([rng.randrange(cr.SYMBOLS) for _ in range(rng.randint(0, 14))], np.int8)
        rows = []
        for k, y in enumerate(symbols.tolist()):
            initial, late = divmod(y - 1, 2)
            rows.append(("user", "", "blank") if y == 0 else (names[initial], f"t{k}", "truncated" if late else ""))
        steps, state = cr.tables().trace(symbols, 0, 0)
        assert "".join(s for s, _ in steps) + cr.closing(state) == best(tuple(rows))[1]
        vectors, ends = cr.tables().function(symbols)
        assert ends[0, 0] == state
        cut = rng.randint(0, len(symbols))
        front, back = cr.tables().function(symbols[:cut]), cr.tables().function(symbols[cut:])
        assert front[0][back[0][0]] == vectors[0] and back[1][0, front[1][back[0][0], 0]] == state


def test_query_equals_brute_force(spark, medium):
    rows = spark.read.parquet(f"{medium}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = brute([tuple(r) for r in rows])
    assert got(llm_queries()["op12_conversation_repair"](spark, medium)) == want
    assert sum(r[6] > 0 for r in want) > 30


def made(seed, n, convs):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "  ", "", None, "Why? ", "so it is!", "é ü.", "a" * 5000, "1", "2.", "3?"]
    turns = defaultdict(lambda: iter(rng.sample(range(3 * n), 3 * n)))
    rows = []
    for _ in range(n):
        conv = rng.choice(convs)
        rows.append((conv, next(turns[conv]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(texts)))
    return rows


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", [1, 2])
def test_large_conversations_lie_in_several_ranges(spark, many_ranges, seed):
    rows = made(seed, 700, [None, 3, 3, 3, 3, 4, 5, 6])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    judged = cr.judged(cr.damaged(frame))
    assert judged.groupBy("conv_id").agg(F.count_distinct("part").alias("n")).where("n > 2").count() >= 1
    assert got(cr.repair_digest(frame)) == brute(rows)


def test_odd_rows(spark):
    schema = "conv_id string, turn long, role string, text string, part int, audit string"
    rows = [("a", None, "user", "same."), ("a", None, "user", "same."), ("b", 1, None, None), ("c", 5, "user", "x" * 100_000), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    plain = lambda f: f.selectExpr("conv_id", "turn", "coalesce(role, ' ') role", "coalesce(text, ' ') text", "1L copies")
    assert got(cr.repair_digest(frame, plain)) == brute(rows, damage=False)
    assert cr.repair_digest(frame.limit(0)).count() == 0
    # A conversation whose every row is dropped stays, with nothing in it.
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert got(cr.repair_digest(one)) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_equal_rows_are_counted_not_listed(spark):
    rows = spark.range(30_000).selectExpr("1L conv_id", "0L turn", "'user' role", "'Hi.' text", "1L copies")
    row = cr.repair_digest(rows, lambda f: f).first()
    assert (row.duplicate, row.illegal, row.cost, len(row.audit), row.audit[:2]) == (29_999, 29_999, 2 * 29_999 + 2, 30_000, "DD")


def test_messages_are_whole(spark):
    rows = [(1, 0, "system", "Be short."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1L copies")
    judged = cr.judged(frame)
    out = cr.repaired(judged, cr.plan_of(judged)).orderBy("part", "seq").collect()
    assert [(r.edit, r.role, r.text) for r in out] == [("K", "system", "Be short."), ("D", "user", "Hi."), ("K", "user", "Hello?"), ("K", "assistant", "Yes.")]
