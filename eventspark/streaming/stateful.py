"""Operators that keep state per key between micro-batches.

Each function takes a stream and gives a stream, and comes in two forms.

With `delay` rows wait in the state until the watermark, so far behind the latest time, has passed them. An event-time
timer per millisecond then hands them on, in time order whatever order they came in, so results are those of the batch
operator on all rows that were not later than `delay`; later ones are dropped by Spark. What a key keeps is let go by
another timer once it can't matter any more: a begun match after its range, a token bucket when it is full again.

Without `delay` rows are taken at once: a key's rows of one micro-batch in time order, held together (bound them with
the source's per-trigger limit), and rows older than ones already seen as they come. State then stays.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from eventspark.functions.clock import micros

US = "_us"
TIE = "_tie"


def _prepare(df: DataFrame, ts: str, tie: str, delay: str | None = None) -> DataFrame:
    if delay is not None:
        df = df.withWatermark(ts, f"{micros(delay)} microseconds")
    return df.withColumns({US: F.unix_micros(ts), TIE: F.col(tie)})


def _only(df: DataFrame, condition: Column, ts: str, delay: str | None) -> DataFrame:
    """Rows that meet a condition. Behind a watermark it names the time as well, or Spark would filter first and rows
    that are no part of a result would not tell the time."""
    return df.filter(condition if delay is None else F.when(F.col(ts).isNotNull(), condition))


def _in_order(rows: Iterable[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r[US], r[TIE]))


def _run(df: DataFrame, key: str, processor: StatefulProcessor, schema, mode: str = "None", delay: str | None = None) -> DataFrame:
    """The processor over a prepared stream; with `delay` it waits for the stream's watermark."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    processor.out = schema.names
    if delay is not None:
        processor, mode = _Waiting(processor, df.schema), "EventTime"
        processor.out = schema.names
    return df.groupBy(key).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode
    )


def _plain(row: Row, names: list[str]) -> list:
    return [row[name] for name in names]


class _Processor(StatefulProcessor):
    """Gives out rows with the field names of the output."""

    out: list[str]

    def row(self, *values) -> Row:
        return Row(*self.out)(*values)

    def close(self) -> None:
        pass


    #: Microseconds after a key's last row when its state can't matter any more; None: it always may.
    idle: int | None = None

    def forget(self) -> None:
        """Let the key's state go."""


class _Waiting(_Processor):
    """Holds rows back until the watermark has passed them and hands them to another processor in time order."""

    def __init__(self, inner: _Processor, schema: StructType):
        self.inner, self.names = inner, schema.names
        self.kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema.fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.inner.init(handle)
        self.waiting = handle.getMapState("waiting", "at long", f"rows array<struct<{self.kind}>>")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[int, list[tuple]] = {}
        for row in rows:
            arrived.setdefault(-(-row[US] // 1000), []).append(tuple(row[n] for n in self.names))
        for at, some in arrived.items():
            if self.waiting.containsKey((at,)):
                some = [*(tuple(r) for r in self.waiting.getValue((at,))[0]), *some]
            else:
                self.handle.registerTimer(at)
            self.waiting.updateValue((at,), (some,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((at,)):
            made = Row(*self.names)
            rows = [made(*r) for r in self.waiting.getValue((at,))[0]]
            self.waiting.removeKey((at,))
            yield from self.inner.handleInputRows(key, rows, timerValues)
            if self.inner.idle is not None:
                self.last.update((at,))
                self.handle.registerTimer(at + self.inner.idle // 1000 + 2)
        elif self.last.exists() and self.last.get()[0] + self.inner.idle // 1000 + 2 <= at:
            self.inner.forget()
            self.last.clear()


class _Value(_Processor):
    """One value of a fixed schema per key."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.STATE)

    def read(self, *default):
        return tuple(self.value.get()) if self.value.exists() else default

    def forget(self) -> None:
        self.value.clear()


class _CountWindows(_Value):
    STATE = "window long, n long, first long"

    def __init__(self, size: int):
        self.size = size

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        window, n, first = self.read(0, 0, 0)
        for row in _in_order(rows):
            first = row[US] if n == 0 else first
            n += 1
            if n == self.size:
                yield self.row(key[0], window, n, first, row[US], True)
                window, n = window + 1, 0
        self.value.update((window, n, first))


def stream_count_windows(
    df: DataFrame, n: int, key: str, ts: str = "timestamp", tie: str = "id", delay: str | None = None
) -> DataFrame:
    """Windows of `n` events per key, given out when full; the open one stays in the state, three numbers a key."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, window_index long, event_count long, first_us long, last_us long, complete boolean"
    prepared = _prepare(df, ts, tie, delay).select(key, US, TIE, *[ts] * (delay is not None))
    found = _run(prepared, key, _CountWindows(n), schema, delay=delay)
    return found.select(
        key, "window_index", "event_count", F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("last_us").alias("last_ts"), "complete",
    )


class _Late(_Value):
    STATE = "latest long"

    def __init__(self, delay: int, names: list[str], arrival: str):
        self.delay, self.names, self.arrival = delay, names, arrival

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (latest,) = self.read(None)
        for row in sorted(rows, key=lambda r: r[self.arrival]):
            late = latest is not None and row[US] < latest - self.delay
            latest = row[US] if latest is None else max(latest, row[US])
            yield self.row(*_plain(row, self.names), late)
        self.value.update((latest,))


def stream_late(df: DataFrame, key: str, delay: str, arrival: str, ts: str = "timestamp") -> DataFrame:
    """Adds `is_late` before Spark drops anything: more than `delay` behind what arrived before for the key."""
    schema = StructType([*df.schema.fields, StructField("is_late", BooleanType())])
    prepared = _prepare(df, ts, arrival)
    return _run(prepared, key, _Late(micros(delay), df.columns, arrival), schema)


class _Relaxed(_Processor):
    def __init__(self, steps: int, within: int, id_type: str):
        self.steps, self.within, self.id_type = steps, within, id_type
        self.idle = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Begun matches: what they have so far, all waiting for step `len(ids)`.
        self.open = handle.getListState("open", f"ids array<{self.id_type}>, times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        open_ = [(list(m[0]), list(m[1])) for m in self.open.get()] if self.open.exists() else []
        for row in _in_order(rows):
            now, kept = row[US], []
            for ids, times in open_:
                if now - times[0] > self.within:
                    continue
                if row["_met"][len(ids)]:
                    ids, times = [*ids, row[TIE]], [*times, now]
                    if len(ids) == self.steps:
                        yield self.row(key[0], ids, times)
                        continue
                kept.append((ids, times))
            if row["_met"][0]:
                kept.append(([row[TIE]], [now]))
            open_ = kept
        if open_:
            self.open.put(open_)
        else:
            self.open.clear()

    def forget(self) -> None:
        self.open.clear()


class _Strict(_Processor):
    """The last rows of a key, one fewer than there are steps: a new row completes them or not."""

    def __init__(self, steps: int, within: int, id_type: str):
        self.steps, self.within, self.id_type = steps, within, id_type
        self.idle = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", f"ids array<{self.id_type}>, times array<long>, met array<array<boolean>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        recent = list(zip(*self.recent.get(), strict=True)) if self.recent.exists() else []
        for row in _in_order(rows):
            recent.append((row[TIE], row[US], list(row["_met"])))
            recent = recent[-self.steps :]
            if len(recent) == self.steps and row[US] - recent[0][1] <= self.within and all(met[k] for k, (_, _, met) in enumerate(recent)):
                yield self.row(key[0], [i for i, _, _ in recent], [at for _, at, _ in recent])
        recent = recent[1 - self.steps :] if self.steps > 1 else []
        self.recent.update(tuple([list(x) for x in zip(*recent, strict=True)] or [[], [], []]))

    def forget(self) -> None:
        self.recent.clear()


def stream_match_strict(
    df: DataFrame, key: str, steps: list[tuple[str, Column]], within: str, ts: str = "timestamp", id_col: str = "id", delay: str | None = None
) -> DataFrame:
    """The streaming form of `match_strict`; give `delay`, as one row out of order hides or makes a match."""
    return _matched(df, key, steps, within, ts, id_col, delay, _Strict)


def stream_match_relaxed(
    df: DataFrame, key: str, steps: list[tuple[str, Column]], within: str, ts: str = "timestamp", id_col: str = "id", delay: str | None = None
) -> DataFrame:
    """The streaming form of `match_relaxed`; begun matches older than `within` are forgotten."""
    return _matched(df, key, steps, within, ts, id_col, delay, _Relaxed)


def _matched(df: DataFrame, key: str, steps: list[tuple[str, Column]], within: str, ts: str, id_col: str, delay: str | None, kind) -> DataFrame:
    met = F.array(*[F.coalesce(condition, F.lit(False)) for _, condition in steps])
    key_type, id_type = (df.schema[c].dataType.simpleString() for c in (key, id_col))
    prepared = _prepare(df, ts, id_col, delay).withColumn("_met", met).select(key, US, TIE, "_met", *[ts] * (delay is not None))
    if kind is _Relaxed:  # other rows are no part of a match
        prepared = _only(prepared, F.exists("_met", lambda m: m), ts, delay)
    processor = kind(len(steps), micros(within), id_type)
    found = _run(prepared, key, processor, f"{key} {key_type}, ids array<{id_type}>, times array<long>", delay=delay)
    columns = []
    for place, (name, _) in enumerate(steps):
        columns += [F.col("ids")[place].alias(f"{name}_id"), F.timestamp_micros(F.col("times")[place]).alias(f"{name}_ts")]
    return found.select(key, *columns)


class _Threshold(_Processor):
    def __init__(self, n: int, within: int, names: list[str]):
        self.n, self.within, self.names = n, within, names
        self.idle = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "times array<long>, counts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # An instant and how many rows it has: rows of one instant are one entry.
        times = deque(zip(*self.seen.get(), strict=True)) if self.seen.exists() else deque()
        held = sum(n for _, n in times)
        rows = _in_order(rows)
        same = Counter(row[US] for row in rows)
        counted = set()
        for row in rows:
            now = row[US]
            if now not in counted:
                # Rows of one instant see each other.
                counted.add(now)
                times.append((now, same[now]))
                held += same[now]
                while times and times[0][0] < now - self.within:
                    held -= times.popleft()[1]
            if held >= self.n:
                yield self.row(*_plain(row, self.names), held)
        self.seen.update(([at for at, _ in times], [n for _, n in times]))

    def forget(self) -> None:
        self.seen.clear()


def stream_threshold(
    df: DataFrame, key: str, condition: Column, n: int, within: str, ts: str = "timestamp", tie: str = "id", delay: str | None = None
) -> DataFrame:
    """The streaming form of `match_threshold`; the state holds the instants of the trailing `within`."""
    prepared = _only(_prepare(df, ts, tie, delay), condition, ts, delay)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", match_count long"
    return _run(prepared, key, _Threshold(n, micros(within), df.columns), schema, delay=delay)


class _Bucket(_Value):
    STATE = "tokens double, last long"

    def __init__(self, rate: float, burst: int, names: list[str]):
        self.rate, self.burst, self.names = rate, burst, names
        self.idle = math.ceil(1_000_000 * burst / rate) if rate > 0 else None  # full again, as at first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # As in the batch form: millionths of tokens, under a nanosecond's shortfall passes.
        whole, full = 1_000_000, self.burst * 1_000_000
        tokens, last = self.read(float(full), None)
        for row in _in_order(rows):
            last = row[US] if last is None else last
            tokens = min(full, tokens + max(row[US] - last, 0) * self.rate)
            last = max(last, row[US])
            allowed = tokens >= whole - self.rate / 1000
            tokens -= whole if allowed else 0
            yield self.row(*_plain(row, self.names), allowed)
        self.value.update((float(tokens), last))


def stream_token_bucket(
    df: DataFrame, key: str, rate: float, burst: int, ts: str = "timestamp", tie: str = "id", delay: str | None = None
) -> DataFrame:
    """The streaming form of `token_bucket`, adding `allowed`."""
    schema = StructType([*df.schema.fields, StructField("allowed", BooleanType())])
    return _run(_prepare(df, ts, tie, delay), key, _Bucket(rate, burst, df.columns), schema, delay=delay)


class _Groups(_Processor):
    """Alerts of a group are gathered until the next flush time; an event-time timer gives them out."""

    def __init__(self, wait: int, interval: int, repeat: int):
        self.wait, self.interval, self.repeat = wait, interval, repeat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "begun long, last long")
        self.known = handle.getMapState("known", "labels string", "first long")
        self.waiting = handle.getMapState("waiting", "tick long", "fresh long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = _in_order(rows)
        begun, last = tuple(self.group.get()) if self.group.exists() else (rows[0][US], None)
        for row in rows:
            past = row[US] - begun - self.wait
            tick = max(-(-past // self.interval), 0)
            fresh, n = tuple(self.waiting.getValue((tick,))) if self.waiting.containsKey((tick,)) else (0, 0)
            if not self.known.containsKey((row["_labels"],)):
                self.known.updateValue((row["_labels"],), (tick,))
                fresh += 1
            self.waiting.updateValue((tick,), (fresh, n + 1))
            if n == 0:
                at = begun + self.wait + tick * self.interval
                self.handle.registerTimer(-(-at // 1000))
        self.group.update((begun, last))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        begun, last = tuple(self.group.get())
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(
            (tick[0], tuple(value)) for tick, value in self.waiting.iterator()
            if begun + self.wait + tick[0] * self.interval <= until
        )
        for tick, (fresh, n) in due:
            self.waiting.removeKey((tick,))
            reason = "new" if fresh else "repeat" if last is None or tick - last >= self.repeat else None
            if reason:
                last = tick
                yield self.row(key[0], begun + self.wait + tick * self.interval, fresh, n, reason)
        self.group.update((begun, last))


def stream_alert_groups(
    df: DataFrame, wait: str, interval: str, repeat: str, delay: str, group: str = "alertname",
    labels: tuple[str, ...] = ("severity", "dev", "instance"), ts: str = "ts",
) -> DataFrame:
    """The streaming form of `group_alerts`; a flush happens once the watermark (`delay` behind) passes it."""
    text = F.to_json(F.struct(*labels))
    prepared = _prepare(df.withColumn("_labels", text), ts, "_labels").select(group, ts, US, TIE, "_labels")
    kind = df.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, at_us long, fresh_alerts long, alert_count long, reason string"
    processor = _Groups(micros(wait), micros(interval), micros(repeat) // micros(interval))
    marked = prepared.withWatermark(ts, f"{micros(delay)} microseconds")
    sent = _run(marked, group, processor, schema, mode="EventTime")
    return sent.select(group, F.timestamp_micros("at_us").alias("notified_at"), "fresh_alerts", "alert_count", "reason")
