"""Conversations repaired by their cheapest edits, found with Four-Russians block tables.

A repaired conversation has role initials `(s?(ua)+)?`. The edits of a row are Keep (0), Rerole to what is due (1) and
Delete (2; required for blank and duplicate rows); Insert (5) adds an empty message of the role that is due; a truncated
row that stays costs 5 more. With four states (nothing yet, after s, after u, after a) the costs to go at a place are a
vector of four. Inserts keep its values near each other, so with the least taken off only a few dozen vectors exist. The
tables hold, for every block of `BLOCK` symbols and every vector behind it, the vector before it and where each state
ends up. Rows are walked from behind, a lookup a block; letters are then traced from the front, each block being expanded
backward from the vector behind it. Of the letters that keep to the cheapest cost the ASCII-least is taken at each place,
which gives the ASCII-least edits of all cheapest ones.

Equal rows of a conversation and turn are one row with a count. Rows lie in ranges of (conversation, turn, role, hash of
the text), null first, so that a large conversation takes several tasks. The part of a conversation in a range is a map
from the vector behind it to the vector before it and from states to states; those of one conversation, one a range, are
put together by its plan, and then every range is traced by itself. Only the digest's hash of a conversation must run
over it from end to end; it does so as a stream, without gathering it.

Null roles and texts are a space, null conversations are one conversation, null turns come first; equal turns go by role
and then by the text's hash. A conversation without rows is repaired as it is. Extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventspark.llm.frames import keep

BLOCK = 4
#: Symbols: a row that must go, then (s, u, a, other) x (whole, truncated).
SYMBOLS = 9
_BIG = 1 << 20
_DUE = (2, 2, 3, 2)  # the state after an inserted or changed message, by state
_KEPT = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}  # by initial: state before, state after
_END = (0, 10, 5, 0)
ROLE = {2: "user", 3: "assistant"}
_SPACES = r"\x20\x09-\x0D"


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of the edits that use up a row, in the order of their letters."""
    out = [("D", 2, state)]
    if symbol:
        initial, late = divmod(symbol - 1, 2)
        if state in _KEPT[initial]:
            out.append(("K", 5 * late, _KEPT[initial][state]))
        out.append(("R", 1 + 5 * late, _DUE[state]))
    return out


def _before(symbol: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row, from those behind it."""
    raw = [min(cost + behind[to] for _, cost, to in _choices(symbol, s)) for s in range(4)]
    u, a = min(raw[2], 5 + raw[3]), min(raw[3], 5 + raw[2])
    return min(raw[0], 5 + u), min(raw[1], 5 + u), u, a


def _step(symbol: int, state: int, before: tuple[int, ...], behind: tuple[int, ...]) -> tuple[str, int]:
    """The least letters by which a state gets past a row at the least cost, and the state then."""
    letters = ""
    while True:
        found = {letter: to for letter, cost, to in _choices(symbol, state) if cost + behind[to] == before[state]}
        if 5 + before[_DUE[state]] == before[state]:
            found["I"] = _DUE[state]
        letter = min(found)
        letters, state = letters + letter, found[letter]
        if letter != "I":
            return letters, state


class Tables:
    """`before[symbol][vector]`, `ends[symbol][vector][state]`, `letters[...]`, and the first two for whole blocks."""

    def __init__(self, block: int = BLOCK):
        number, todo = {_END: 0}, [_END]
        link: dict[tuple[int, int], int] = {}
        exact: dict[tuple[int, int], tuple] = {}
        while todo:
            behind = todo.pop()
            for y in range(SYMBOLS):
                before = _before(y, behind)
                low = min(before)
                plain = tuple(x - low for x in before)
                if plain not in number:
                    number[plain] = len(number)
                    todo.append(plain)
                link[y, number[behind]], exact[y, number[behind]] = number[plain], (before, behind)
        n = len(number)
        self.before = np.array([[link[y, v] for v in range(n)] for y in range(SYMBOLS)], np.int16)
        steps = [[[_step(y, s, *exact[y, v]) for s in range(4)] for v in range(n)] for y in range(SYMBOLS)]
        self.letters = [[[s[0] for s in v] for v in y] for y in steps]
        self.ends = np.array([[[s[1] for s in v] for v in y] for y in steps], np.int8)
        self.block = block
        many, to = self.before, self.ends
        for _ in range(block - 1):  # one more symbol in front
            size = len(many)
            longer = self.before[:, many]  # (symbol, block, vector)
            first = self.ends[np.arange(SYMBOLS)[:, None, None], many[None]]  # the state after that symbol
            to = np.take_along_axis(np.broadcast_to(to, (SYMBOLS, *to.shape)), first.astype(np.int64), axis=3).reshape(SYMBOLS * size, n, 4)
            many = longer.reshape(SYMBOLS * size, n)
        self.block_before, self.block_ends = many, to
        self.vectors = n
        self.step_before = self.before.tolist()
        self.step_ends = self.ends.tolist()
        self.power = SYMBOLS ** np.arange(block - 1, -1, -1)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of the whole blocks from the front; less than a block of symbols may be left behind them."""
        whole = len(symbols) // self.block * self.block
        return symbols[:whole].reshape(-1, self.block).astype(np.int64) @ self.power

    def function(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the symbols: the vector before them, and for each state in front the state behind."""
        vector, ends = np.arange(self.vectors), np.tile(np.arange(4), (self.vectors, 1))
        codes = self.codes(symbols)
        for y in symbols[len(codes) * self.block :][::-1].tolist():
            ends = np.take_along_axis(ends, self.ends[y][vector].astype(np.int64), axis=1)
            vector = self.before[y][vector]
        for code in codes[::-1].tolist():
            ends = np.take_along_axis(ends, self.block_ends[code][vector].astype(np.int64), axis=1)
            vector = self.block_before[code][vector]
        return vector, ends

    def trace(self, symbols: np.ndarray, behind: int, state: int) -> tuple[list[tuple[str, int]], int]:
        """(letters, state before them) of each row, and the state behind all, for a known vector behind and state in front."""
        codes, given = self.codes(symbols).tolist(), symbols.tolist()
        rest = given[len(codes) * self.block :]
        vector = behind
        for y in reversed(rest):
            vector = self.step_before[y][vector]
        borders = [vector]
        for code in reversed(codes):
            borders.append(int(self.block_before[code, borders[-1]]))
        out: list[tuple[str, int]] = []
        blocks = [(given[k * self.block : (k + 1) * self.block], borders[len(codes) - 1 - k]) for k in range(len(codes))]
        for part, border in [*blocks, (rest, behind)]:
            inner = [border]  # the vectors behind each symbol, from the last
            for y in reversed(part[1:]):
                inner.append(self.step_before[y][inner[-1]])
            for y, v in zip(part, reversed(inner), strict=False):
                out.append((self.letters[y][v][state], state))
                state = self.step_ends[y][v][state]
        return out, state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def closing(state: int) -> str:
    """The inserts that end a conversation."""
    return "I" * (_END[state] // 5)


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) with a fifth of the rows harmed, by a hash of conversation and turn."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat_ws(":", plain(conv_id), plain(turn))), F.lit(20))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"), fate.alias("fate"))
    words = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), words.alias("text"),
        F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _joined(rows: DataFrame, other: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Joined on columns of these names, nulls being equal; of them only those of `rows` stay."""
    other = other.withColumnsRenamed({n: f"{n}_" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    return rows.join(other, on, how).drop(*[f"{n}_" for n in names])


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows in ranges, with their symbols and how many of their copies have each fault; kept in the shared folder.

    `part` numbers the ranges in order.
    """
    hashes = [F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2")]
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).select("*", *hashes)
    point = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv_id", "h1", "h2").agg(F.min(point).alias("first"))
    seen = _joined(rows, first, ["conv_id", "h1", "h2"]).withColumn("seen", F.col("first") < point)
    blank = ~F.col("text").rlike(f"[^{_SPACES}]")
    late = ~F.col("text").rlike(rf"[.!?][{_SPACES}]*\z")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    gone = blank | F.col("seen")
    zero = F.lit(0).cast("long")
    seen = seen.select(
        "conv_id", "turn", "role", "text", "copies", "h1", F.when(gone, 0).otherwise(1 + 2 * place + late.cast("int")).cast("int").alias("symbol"), initial.alias("initial"),
        F.when(blank, F.col("copies")).otherwise(zero).alias("blank"),
        F.when(blank, zero).otherwise(F.col("copies") - F.when(F.col("seen"), 0).otherwise(1)).alias("duplicate"),
        F.when(~gone & late, 1).otherwise(0).cast("long").alias("truncated"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h1"]
    return keep(seen.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("h1"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[dict]]]:
    """(id as an array of one, rows) of the conversations of a range, which come in order. Column 0 has the ids."""
    held: list[dict] = []
    own: pa.Array | None = None
    for batch in batches:
        rows, ids = batch.to_pylist(), batch.column(0)
        for k, row in enumerate(rows):
            if own is not None and row["conv_id"] != held[-1]["conv_id"]:
                yield own, held
                held, own = [], None
            if own is None:
                own = ids.slice(k, 1)
            held.append(row)
    if own is not None:
        yield own, held


def _emitted(schema: list[tuple[str, pa.DataType]], pieces: Iterator[tuple[pa.Array, list[tuple]]], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each with the id of its conversation in front."""
    names = ["conv_id", *[n for n, _ in schema]]
    ids: list[pa.Array] = []
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(schema)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names)

    for own, found in pieces:
        for row in found:
            ids.append(own)
            rows.append(row)
            if len(rows) >= most:
                yield batch()
                ids, rows = [], []
    if rows:
        yield batch()


def _symbols(rows: list[dict]) -> np.ndarray:
    return np.array([r["symbol"] for r in rows], np.int8)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple[pa.Array, list[tuple]]]:
        for own, rows in _pieces(batches):
            vector, ends = tables().function(_symbols(rows))
            yield own, [(rows[0]["part"], vector.astype("<i2").tobytes(), ends.astype("i1").tobytes())]

    yield from _emitted([("part", pa.int32()), ("vectors", pa.binary()), ("ends", pa.binary())], found())


def _planned(group: pa.Table) -> pa.Table:
    """What is behind each part of one conversation, from the last part, and the state in front of it, from the first."""
    group = group.sort_by("part")
    maps = [np.frombuffer(x, "<i2") for x in group["vectors"].to_pylist()]
    ends = [np.frombuffer(x, "i1").reshape(-1, 4) for x in group["ends"].to_pylist()]
    behind, state, states = [0], 0, []
    for m in maps[:0:-1]:
        behind.append(int(m[behind[-1]]))
    behind.reverse()
    for e, v in zip(ends, behind, strict=True):
        states.append(state)
        state = int(e[v, state])
    last = [False] * (len(maps) - 1) + [True]
    return pa.table({"conv_id": group["conv_id"], "part": group["part"], "behind": pa.array(behind, pa.int32()), "state": pa.array(states, pa.int32()), "last": last})


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple[pa.Array, list[tuple]]]:
        for own, rows in _pieces(batches):
            part, state, last = rows[0]["part"], rows[0]["state"] or 0, rows[0]["last"] is not False
            steps, state = tables().trace(_symbols(rows), rows[0]["behind"] or 0, state)
            out: list[tuple] = []

            def insert(state: int) -> int:
                out.append((part, len(out), "I", 1, 5, ROLE[_DUE[state]], ""))
                return _DUE[state]

            for row, (letters, at) in zip(rows, steps, strict=True):
                for letter in letters:
                    if letter == "I":
                        at = insert(at)
                    elif letter == "D":
                        out.append((part, len(out), "D", 1, 2, row["role"], row["text"]))
                    else:
                        late = 5 * row["truncated"]
                        role = row["role"] if letter == "K" else ROLE[_DUE[at]]
                        out.append((part, len(out), letter, 1, late + (letter == "R"), role, row["text"]))
                if row["copies"] > 1:
                    more = row["copies"] - 1
                    out.append((part, len(out), "D", more, 2 * more, row["role"], row["text"]))
            for _ in closing(state) if last else "":
                state = insert(state)
            yield own, out

    yield from _emitted([("part", pa.int32()), ("seq", pa.int64()), ("edit", pa.string()), ("times", pa.int64()), ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string())], found())


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Illegal neighbours within each part of a conversation, and its first and last initials."""

    def found() -> Iterator[tuple[pa.Array, list[tuple]]]:
        for own, rows in _pieces(batches):
            x = [r["initial"] for r in rows]
            bad = sum(not legal(a + b) for a, b in zip(x, x[1:], strict=False)) + sum(r["copies"] - 1 for r in rows)
            yield own, [(rows[0]["part"], bad, x[0], x[-1])]

    yield from _emitted([("part", pa.int32()), ("bad", pa.int64()), ("first", pa.string()), ("last", pa.string())], found())


def legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost, edits and hash of each conversation from its edited messages in order, as a stream."""

    def found() -> Iterator[tuple[pa.Array, list[tuple]]]:
        own = None
        for batch in batches:
            ids = batch.column(0)
            for k, row in enumerate(batch.to_pylist()):
                if own is None or row["conv_id"] != own[1]:
                    if own is not None:
                        yield own[0], [(cost, "".join(audit), sha.hexdigest())]
                    own, cost, audit, sha, mark = (ids.slice(k, 1), row["conv_id"]), 0, [], hashlib.sha256(), b""
                cost += row["cost"]
                audit.append(row["edit"] * row["times"])
                if row["edit"] != "D":
                    sha.update(mark + f"{row['role']}:{row['text']}".encode())
                    mark = b"\n"
        if own is not None:
            yield own[0], [(cost, "".join(audit), sha.hexdigest())]

    yield from _emitted([("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())], found())


def _split(rows: DataFrame) -> DataFrame:
    """(conv_id, part) of the conversations that lie in several ranges: at most two a range."""
    edges = rows.groupBy("part").agg(F.array(F.min(F.struct("conv_id")), F.max(F.struct("conv_id"))).alias("e"))
    edges = edges.select("part", F.explode(F.array_distinct("e")).alias("e")).select(F.col("e.conv_id").alias("conv_id"), "part")
    several = edges.groupBy("conv_id").agg(F.count("*").alias("n"), F.collect_list("part").alias("parts")).where("n > 1")
    return several.select("conv_id", F.explode("parts").alias("part"))


def plan_of(rows: DataFrame) -> DataFrame:
    """conv_id, part, behind, state, last of the conversations that lie in several ranges; kept, at most two rows a range."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    wide = F.broadcast(_split(rows))  # bounded by the number of ranges
    pieces = _joined(rows.select("conv_id", "part", "symbol"), wide, ["conv_id", "part"])
    found = pieces.mapInArrow(_functions, f"conv_id {kind}, part int, vectors binary, ends binary")
    return keep(found.groupBy("conv_id").applyInArrow(_planned, f"conv_id {kind}, part int, behind int, state int, last boolean"))


def repaired(rows: DataFrame, plan: DataFrame, wide: bool | None = None) -> DataFrame:
    """Edited messages (conv_id, part, seq, edit, times, cost, role, text), deleted ones too, of judged rows.

    `wide` picks the conversations that lie in several ranges or the others; order is by part and seq.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    how = {None: "left", True: "inner", False: "left_anti"}[wide]
    picked = rows.select("conv_id", "part", "role", "text", "copies", "symbol", "truncated")
    picked = _joined(picked, F.broadcast(plan), ["conv_id", "part"], how)  # bounded by the number of ranges
    if wide is False:
        picked = picked.selectExpr("*", "int(null) behind", "int(null) state", "boolean(null) last")
    return picked.mapInArrow(_traced, f"conv_id {kind}, part int, seq long, edit string, times long, cost long, role string, text string")


def repair_digest(conversations: DataFrame, harm: Callable[[DataFrame], DataFrame] = damaged) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    rows = judged(harm(conversations))
    plan = plan_of(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, cost long, audit string, repaired_sha256 string"
    whole = repaired(rows, plan, False).mapInArrow(_hashed, schema)
    wide = repaired(rows, plan, True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_hashed, schema)
    counts = rows.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    pieces = rows.select("conv_id", "part", "initial", "copies").mapInArrow(_adjacent, f"conv_id {kind}, part int, bad long, first string, last string")
    pair = F.concat(F.lag("last").over(Window.partitionBy("conv_id").orderBy("part")), F.col("first"))  # a row a range
    pieces = pieces.withColumn("bad", F.col("bad") + F.when(~pair.isin("su", "ua", "au"), 1).otherwise(0))
    illegal = pieces.groupBy("conv_id").agg(F.sum("bad").alias("illegal"))
    every = conversations.select("conv_id").distinct()
    for part in (counts, illegal, whole, wide):
        every = every.unionByName(part, allowMissingColumns=True)
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*figures, "audit", "repaired_sha256"]])
    return found.select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in figures],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
