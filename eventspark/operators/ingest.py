"""Ingestion: single events, typed batches, HTTP batches, sequential sends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.text import format_error
from eventspark.operators.ordered import Running, prefix, split
from eventspark.operators.records import DEFAULT_PARTITIONS, with_offsets, with_partition
from eventspark.session import materialise
from eventspark.operators.validate import (
    http_error, stamp_metadata, validate_http, validate_typed, with_defaults, with_request_id,
)
from eventspark.sources.requests import INVALID_JSON, MAX_BATCH

# Result states and the message of a failed send.
ACCEPTED, REJECTED, FAILED = "ACCEPTED", "REJECTED", "FAILED"
SEND_FAILED = "failed to produce to Kafka"
VALIDATION_FAILED = "validation_failed"


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the `error` column."""
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())


def ingest(
    df: DataFrame, protocol: str = "typed", topic_partitions: int = DEFAULT_PARTITIONS,
    arrival: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Validate, fill, place and number events: (accepted with partition and offset, rejected).

    `arrival` lists the columns giving arrival order; without it no offsets are assigned (as on a
    stream, where the topic sink does), and ids and times that are generated differ from reading to reading. With it
    the accepted events are fixed in the shared folder first.
    """
    prepared = with_request_id(df)
    if protocol == "http":
        checked = validate_http(prepared)
        if "decode_error" in df.columns:
            checked = checked.withColumn("error", F.coalesce("decode_error", "error"))
        accepted, rejected = split_valid(checked)
        accepted = stamp_metadata(with_defaults(accepted, always=True))
    else:
        accepted, rejected = split_valid(validate_typed(prepared))
        accepted = with_defaults(accepted)
    accepted = accepted.withColumn("status", F.lit(ACCEPTED))
    kind = F.when(F.col("error") == INVALID_JSON, INVALID_JSON).otherwise(VALIDATION_FAILED)
    rejected = rejected.withColumns(
        {"status": F.lit(REJECTED), "error_type": kind, "error_message": F.col("error")}).drop("error")
    accepted = with_partition(accepted, topic_partitions, key="type")
    if arrival:
        # Offsets are worked out from one reading of the rows; ids and times made for them must be those of that reading.
        accepted = with_offsets(materialise(accepted), arrival)
    return accepted, rejected


# The code and text by which an empty typed batch is refused.
INVALID_ARGUMENT, BATCH_EMPTY = "InvalidArgument", "batch cannot be empty"


def ingest_batch(
    df: DataFrame, batch_id: str, idx: str, fail_fast: bool = False, send_failed: Column | None = None
) -> DataFrame:
    """Per-event result of typed batches: `status` and `error_message`, valid events go through.

    With `fail_fast` a batch's results end with its first failure.
    """
    failed = F.coalesce(send_failed, F.lit(False)) if send_failed is not None else F.lit(False)
    checked = validate_typed(df).withColumns(
        {
            "status": F.when(F.col("error").isNotNull(), REJECTED).when(failed, FAILED).otherwise(ACCEPTED),
            "error_message": F.coalesce("error", F.when(failed, F.lit(SEND_FAILED))),
        }
    ).drop("error")
    if not fail_fast:
        return checked
    bad = (F.col("status") != ACCEPTED).cast("long")
    # A batch has no upper size: failures ahead of a row are counted block by block.
    before = prefix(split(checked, [batch_id], [idx]), {"_bad": Running("sum", bad)}, inclusive=False)
    return before.df.filter(F.coalesce("_bad", F.lit(0)) == 0).select(*checked.columns)


def open_batches(batches: DataFrame, batch_id: str, events: str = "events") -> tuple[DataFrame, DataFrame]:
    """Typed batches, a row each with an array of events: (an event a row with `idx`, refused batches with `error`).

    A batch without events is refused, as a batch of rows can't tell.
    """
    rest = [c for c in batches.columns if c != events]
    opened = batches.select(*rest, F.posexplode(events).alias("idx", "_event")).select(*rest, "idx", "_event.*")
    empty = batches.filter(F.coalesce(F.size(events), F.lit(0)) <= 0)
    return opened, empty.select(batch_id, F.lit(INVALID_ARGUMENT).alias("code"), F.lit(BATCH_EMPTY).alias("error"))


def batch_summary(results: DataFrame, batch_id: str) -> DataFrame:
    return results.groupBy(batch_id).agg(
        F.count_if(F.col("status") == ACCEPTED).alias("success_count"),
        F.count_if(F.col("status") != ACCEPTED).alias("failure_count"),
        F.count(F.lit(1)).alias("result_count"),
    )


def ingest_batch_http(df: DataFrame, batch_id: str, idx: str) -> tuple[DataFrame, DataFrame]:
    """HTTP batches are accepted or refused whole: (events of accepted batches, one row per batch).

    Refused are batches that didn't decode (`batch_error`, where `explode_batch` gives it), those of no or more
    than 100 events, and those with any invalid event; the first error is told. A row without `idx` is no event.
    """
    whole = F.coalesce("batch_message", "batch_error") if "batch_error" in df.columns else F.lit(None).cast("string")
    is_event = F.col(idx).isNotNull() & whole.isNull()
    checked = df.withColumns({"_event": is_event, "_whole": whole, "_error": F.when(is_event, http_error())})
    batches = checked.groupBy(batch_id).agg(
        F.count_if("_event").alias("event_count"), F.max("_whole").alias("_whole"),
        F.min(F.when(F.col("_error").isNotNull(), F.struct(F.col(idx).alias("at"), F.col("_error").alias("error")))).alias("_first"),
    )
    size = F.when(F.col("event_count") < 1, format_error("Events", "min")).when(
        F.col("event_count") > MAX_BATCH, format_error("Events", "max"))
    batches = batches.withColumn("error", F.coalesce("_whole", size, F.col("_first.error"))).drop("_first", "_whole")
    refused = F.col("error").isNotNull()
    summary = batches.select(
        batch_id, "event_count",
        F.when(refused, 0).otherwise(F.col("event_count")).alias("processed_count"),
        F.lit(0).cast("long").alias("failed_count"),
        F.when(refused, 400).otherwise(202).alias("status_code"),
        "error",
    )
    good = batches.filter(~refused).select(F.col(batch_id).alias("_batch"))
    accepted = df.filter(is_event).join(good, F.col(batch_id).eqNullSafe(F.col("_batch")), "left_semi")
    return accepted, summary


def accept_batch_http(df: DataFrame, batch_id: str, idx: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `ingest_batch_http`, and what an accepted batch becomes: (events, a result per event, one row per batch).

    Events get a new id and time and the stamps of the request with their `batch_index`. They are fixed in the shared
    folder, so that results name the ids that the events have.
    """
    accepted, summary = ingest_batch_http(df, batch_id, idx)
    events = materialise(with_defaults(stamp_metadata(accepted, batch_index=idx), always=True))
    results = events.select(batch_id, idx, F.col("id").alias("event_id"), F.lit("accepted").alias("status"))
    return events, results, summary


def send_batch(df: DataFrame, batch_id: str, idx: str, failed: str) -> DataFrame:
    """Sequential send: adds `sent`, false from a batch's first failure on; earlier rows stay sent."""
    flag = F.coalesce(F.col(failed), F.lit(False)).cast("long")
    seen = prefix(split(df, [batch_id], [idx]), {"_failures": Running("sum", flag)})
    return seen.df.select(*df.columns, (F.col("_failures") == 0).alias("sent"))


def batch_results(results: DataFrame, batch_id: str, idx: str) -> DataFrame:
    """Results in request order."""
    return results.orderBy(batch_id, idx)


def by_priority(df: DataFrame, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Higher priority first, then older first, then by `tie`, a row id that makes the order one."""
    return df.orderBy(F.col("priority").desc(), F.col(ts).asc(), *[tie] * (tie is not None))


def union_protocols(http: DataFrame, typed: DataFrame) -> DataFrame:
    """Events of both protocols for one topic; fields a protocol lacks are null."""
    return http.unionByName(typed, allowMissingColumns=True)
