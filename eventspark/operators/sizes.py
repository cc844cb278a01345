"""Broadcast only what has been measured to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, max_rows: int | None = None, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a frame has at most so many rows, and so many bytes as JSON text."""
    max_rows = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(text)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def join_lookup(
    big: DataFrame, lookup: DataFrame, on: str | list[str] | Column, how: str = "left",
    max_rows: int | None = None,
) -> DataFrame:
    """Join a configuration-like table: broadcast below `max_rows`, otherwise a shuffle join.

    The shuffle join leaves hot keys to adaptive skew handling, which splits them.
    """
    if not lookup.isStreaming and is_small(lookup, max_rows):
        lookup = F.broadcast(lookup)
    return big.join(lookup, on, how)
