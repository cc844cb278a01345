"""Maximal runs of periodically repeated words, by branching tandem repeats in an enhanced suffix array.

Some texts at a time become one array of word numbers; a word of one text is no word of another, so nothing crosses
texts. The suffix array comes from prefix doubling in which only suffixes that are still tied are sorted again; the
ranks of each doubling give the LCP of neighbours. An LCP interval is the stretch between the nearest smaller LCP
values on either side; its children lie between the places where the LCP is its depth. For every suffix i of all
children but the largest, ISA[i + depth] and ISA[i - depth] are looked up: inside the interval but outside the child,
the two suffixes part after exactly `depth` words, so a square of that period starts at the earlier one and its last
word ends a run. Squares that could reach the wanted length are rotated left as far as the words allow and merged by
their end: a longer period within a run found before is a multiple of its period. No tree is built.

The work is n log n in the words of a text, all of it in arrays of at most `EXPAND` suffixes or the text itself; a text
beyond `SLICE` bytes is handled alone and takes some 200 bytes a word. Nothing is shuffled and no key matters.

Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows are handled each. Ties between
runs are settled by start, then period. Words are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from eventspark.llm.frames import free_name
from eventspark.llm.words import slices

LEAST = 12
SLICE, EXPAND = 2 << 20, 2_000_000
_RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def suffix_array(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their ranks, LCP with the suffix before) of integers; a suffix ends before `end` of its place."""
    n = len(key)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    lone = new & np.append(new[1:], True)
    slot = np.flatnonzero(~lone)
    first = ~new
    step, levels = 1, [rank.astype(np.int32)]
    while len(slot):
        tied = order[slot]
        ahead = tied + step
        inside = ahead < end[tied]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        pair = rank[tied] * (n + 1) + second
        at = np.argsort(pair)
        pair, tied = pair[at], tied[at]
        order[slot] = tied
        new = np.ones(len(slot), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[tied] = np.maximum.accumulate(np.where(new, slot, 0))
        lone = new & np.append(new[1:], True)
        slot = slot[~lone]
        step *= 2
        levels.append(rank.astype(np.int32))
    lcp = np.zeros(n, np.int64)
    place = np.flatnonzero(first)
    left, right = order[place - 1], order[place]
    stop = end[left]
    common = np.ones(len(place), np.int64)  # they share their first word
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = np.maximum(a, b) < stop
        same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        common += same << k
    lcp[place] = common
    return order, rank, lcp


def nearest_smaller(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places `at`: the nearest place before and behind with a smaller value; place 0 and the end count as smaller."""
    n = len(values)
    least = [values]
    while (span := 1 << len(least)) <= n:
        least.append(np.minimum(least[-1][: n - span + 1], least[-1][span // 2 : n - span // 2 + 1]))
        if not least[-1].any():
            break
    own = values[at]
    before, behind = at.copy(), at + 1
    for k in range(len(least) - 1, -1, -1):
        span, table = 1 << k, least[k]
        to = before - span
        far = to >= 1
        before -= (far & (table[np.where(far, to, 0)] >= own)) * span
        far = behind + span <= n
        behind += (far & (table[np.where(far, behind, 0)] >= own)) * span
    return before - 1, behind


def branching_squares(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of all squares whose period doesn't go on behind them, each once."""
    n = len(order)
    split = np.flatnonzero(lcp > 0)
    if not len(split):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = nearest_smaller(lcp, split)  # the interval has the suffixes low to high - 1
    at = np.lexsort((split, low * (n + 1) + high))
    split, low, high = split[at], low[at], high[at]
    head = np.ones(len(split), bool)
    head[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    number = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    # Children: one from the interval's start, then one from each split.
    start = np.insert(split, heads, low[heads])
    own = np.insert(number, heads, number[heads])
    low, high, depth = low[heads][own], high[heads][own], lcp[split[heads]][own]
    last = np.append(own[1:] != own[:-1], True)
    stop = np.where(last, high, np.append(start[1:], 0))
    size = stop - start
    by_size = np.lexsort((-size, own))
    largest = by_size[np.flatnonzero(np.append(True, own[1:] != own[:-1]))]
    small = np.ones(len(size), bool)
    small[largest] = False
    start, stop, low, high, depth, size = (x[small] for x in (start, stop, low, high, depth, size))
    starts, periods = [], []
    upto = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + EXPAND, "right")))
        part = slice(a, b)
        child = np.repeat(np.arange(a, b), size[part])
        inside = np.arange(len(child)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        suffix, period = order[start[child] + inside], depth[child]
        for sign in (1, -1):
            other = suffix + sign * period
            valid = (other >= 0) & (other < n)
            r = rank[np.where(valid, other, 0)]
            hit = valid & (r >= low[child]) & (r < high[child]) & ((r < start[child]) | (r >= stop[child]))
            starts.append(np.minimum(suffix, other)[hit])
            periods.append(period[hit])
        a = b
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return both[0], both[1]


def _rotated(key: np.ndarray, start: int, period: int) -> int:
    """The earliest start of the run that a square at `start` belongs to."""
    step = 64
    while start:
        a = max(0, start - step)
        other = np.flatnonzero(key[a:start] != key[a + period : start + period])
        if len(other):
            return a + int(other[-1]) + 1
        start, step = a, step * 2
    return 0


def runs_of(key: np.ndarray, end: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and two periods, by start and period.

    `key` numbers the words, no two texts sharing one; `end` has for each word the end of its text.
    """
    if len(key) < least:
        return []
    start, period = branching_squares(*suffix_array(key, end))
    close = start + 2 * period
    # Rotate those that are too short as far as they must go; most stop at once.
    short = np.maximum(0, least - 2 * period)
    alive = start >= short
    for back in range(1, int(short[alive].max(initial=0)) + 1):
        check = np.flatnonzero(alive & (short >= back))
        alive[check] = key[start[check] - back] == key[start[check] - back + period[check]]
    at = np.flatnonzero(alive)
    at = at[np.lexsort((period[at], close[at]))]
    out: list[tuple[int, int, int]] = []
    last, opened = -1, []
    for i, q, e in zip(start[at].tolist(), period[at].tolist(), close[at].tolist(), strict=True):
        if e != last:
            last, opened = e, []
        if any(i >= s for s in opened):  # a multiple of a shorter period of the same run
            continue
        s = _rotated(key, i, q)
        opened.append(s)
        out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _mark(least: int, place: int, names: list[str]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, place, SLICE):
            words = [t.split() if t else [] for t in texts]
            counts = np.array([len(w) for w in words])
            bound = np.concatenate([[0], np.cumsum(counts)])
            number = _Numbers().__getitem__
            key = np.fromiter((number(x) for w in words for x in w), np.int64, bound[-1])
            doc = np.repeat(np.arange(len(words)), counts)
            key += doc * (int(key.max(initial=0)) + 1)
            found = runs_of(key, bound[1:][doc], least)
            dropped = np.zeros(len(key) + 1, np.int64)
            start, length, period = np.array(found, np.int64).reshape(-1, 3).T
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, start + length, -1)
            gone = np.cumsum(dropped)[:-1] > 0
            collapsed = []
            some = np.add.reduceat(np.append(gone, False), bound[:-1]) * (counts > 0) if len(words) else []
            for w, a, n, any_gone in zip(words, bound, counts, some, strict=False):
                kept = [x for x, g in zip(w, gone[a : a + n], strict=True) if not g] if any_gone else w
                collapsed.append(b" ".join(kept).decode())
            of = doc[start] if len(start) else start
            offset = np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(start - bound[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.ListArray.from_arrays(pa.array(offset), entries), pa.array(collapsed, pa.string())], names)

    return mark


def find_runs(documents: DataFrame, text: str = "text", least: int = LEAST) -> tuple[DataFrame, str, str]:
    """All columns, each row's runs and its text with only the first period of every run kept; and these two names.

    `runs` is an array of (start, length, period) in words, `collapsed` the kept words joined by single spaces.
    """
    runs, collapsed = free_name(documents, "runs"), free_name(documents, "collapsed")
    schema = StructType([*documents.schema.fields, StructField(runs, _RUNS), StructField(collapsed, StringType())])
    mark = _mark(least, documents.columns.index(text), schema.names)
    return documents.mapInArrow(mark, schema), runs, collapsed


def repeated_text(text: Column, number: Column) -> Column:
    """Its words with those from place g % n on made periodic, where `number` is g: a text with a planted run."""

    @F.pandas_udf("string")
    def repeat(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(texts, numbers, strict=True):
            words = t.encode().split() if isinstance(t, str) else []
            if words:
                g, n = int(g), len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]
            out.append(b" ".join(words).decode())
        return pd.Series(out, dtype=object)

    return repeat(text, number)


def runs_digest(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_runs, the longest run and hashes of all runs and of the collapsed text, of texts with planted runs.

    A text whose id has a crc32 divisible by ten gets a run; a null id has none.
    """
    hashed = F.crc32(F.col(doc_id).cast("string"))
    planted = F.pmod(hashed, F.lit(10)) == 0
    plain = F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(F.floor(hashed / 10), F.lit(0)).cast("long")
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.when(planted, repeated_text(F.when(planted, plain), number)).otherwise(plain).alias("text"))
    found, runs, collapsed = find_runs(rows)
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.n") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(collapsed, 256).alias("collapsed_sha256"))
