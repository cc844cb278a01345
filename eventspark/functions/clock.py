"""Identifiers, clocks, durations and retry times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit letter of a duration literal.
UNIT_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


def new_id() -> Column:
    """A random UUID v4; materialise the result before using it twice."""
    return F.expr("uuid()")


def now_utc() -> Column:
    """One value per query or micro-batch."""
    return F.current_timestamp()


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from `start` to `end`."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000)).cast("long")


def parse_duration(text: str | Column) -> float | Column:
    """Seconds of a literal such as `5m` or `1h`; a column gives a double column (null if malformed)."""
    if isinstance(text, Column):
        number = F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d)$", 1)
        unit = F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d)$", 2)
        factor = F.lit(None).cast("double")
        for name, seconds in UNIT_SECONDS.items():
            factor = F.when(unit == name, F.lit(float(seconds))).otherwise(factor)
        return F.when(number != "", number.cast("double")) * factor
    match = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text.strip())
    if not match:
        raise ValueError(f"not a duration literal: {text!r}")
    return int(match[1]) * UNIT_SECONDS[match[2]]


def micros(text: str) -> int:
    return round(parse_duration(text) * 1_000_000)


def interval_text(text: str) -> str:
    """A duration literal as interval text for window functions and watermarks."""
    return f"{micros(text)} microseconds"


def add_seconds(ts: Column, seconds: Column | float) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(F.unix_micros(ts) + (seconds * 1_000_000).cast("long"))


def backoff(ts: Column, retry_count: Column, base_seconds: float) -> Column:
    """`ts` plus base times two to the power of the retries made so far."""
    return add_seconds(ts, F.lit(float(base_seconds)) * F.pow(F.lit(2.0), retry_count))
