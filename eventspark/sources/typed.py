"""Typed events and the frames of a bidirectional event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.operators.validate import typed_error

MODEL_COLUMNS = [
    "id", "type", "source", "tenant_id", "data", "timestamp", "schema_version", "metadata",
    "correlation_id", "priority",
]


def from_typed_events(df: DataFrame) -> DataFrame:
    """Typed rows to the internal event: null payload becomes an empty object, null time becomes now."""
    filled = df.withColumns(
        {
            "data": F.coalesce("data", F.lit("{}")),
            "timestamp": F.coalesce("timestamp", F.current_timestamp()),
            "priority": F.coalesce("priority", F.lit(0)),
        }
    )
    return filled.select(*MODEL_COLUMNS, *[c for c in df.columns if c not in MODEL_COLUMNS])


def demux_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split frames `event | ping | config` into (events to ingest, responses `ack | pong | status`).

    An invalid event answers with an ERROR status and the stream goes on; configs are not answered.
    Other columns (stream id, sequence) are carried through. Stateless, so it also runs on a stream.
    """
    arms = {"event", "ping", "config"}
    carried = [c for c in frames.columns if c not in arms]
    opened = frames.withColumn(
        "_error", F.when(F.col("event").isNotNull(), typed_error(lambda name: F.col(f"event.{name}")))
    )
    events = opened.filter(F.col("event").isNotNull() & F.col("_error").isNull()).select(*carried, "event.*")

    now = F.current_timestamp()
    is_event = F.col("event").isNotNull()
    ack = F.when(
        is_event & F.col("_error").isNull(),
        F.struct(F.col("event.id").alias("event_id"), F.lit("ACCEPTED").alias("status"), now.alias("accepted_at")),
    )
    pong = F.when(F.col("ping").isNotNull(), F.struct(now.alias("timestamp")))
    status = F.when(
        F.col("_error").isNotNull(),
        F.struct(F.lit("ERROR").alias("code"), F.col("_error").alias("message"), now.alias("timestamp")),
    )
    responses = opened.filter(is_event | F.col("ping").isNotNull()).select(
        *carried, ack.alias("ack"), pong.alias("pong"), status.alias("status")
    )
    return events, responses
