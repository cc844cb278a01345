"""Validation, defaults and request handling of incoming events.

Null and empty text both count as missing; white space does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eventspark.functions.clock import new_id, now_utc
from eventspark.functions.payload import is_object, to_variant
from eventspark.functions.text import blank_to_null, format_error, parse_size

# Messages of the typed validation.
NIL_EVENT = "event cannot be nil"
TYPE_REQUIRED = "event type is required"
SOURCE_REQUIRED = "event source is required"
DATA_REQUIRED = "event data is required"
# The typed payload is a structure; as text it has to be a JSON object.
DATA_OBJECT = "event data must be a JSON object"

# Outcome codes.
ACCEPTED, BAD_REQUEST, TOO_LARGE, TOO_MANY, FAILED = 202, 400, 413, 429, 500

# Metadata keys set by the receiving side.
STAMPED = ["request_id", "client_ip", "user_agent", "batch_index"]


def _missing(value: Column) -> Column:
    return blank_to_null(value).isNull()


def http_error() -> Column:
    """The first failing field of a request, or null."""
    return (
        F.when(_missing(F.col("type")), format_error("Type", "required"))
        .when(_missing(F.col("source")), format_error("Source", "required"))
        .when(F.col("data").isNull(), format_error("Data", "required"))
    )


def typed_error(column: Callable[[str], Column] = F.col) -> Column:
    """The first failing check of a typed event, or null; `column` finds the event's fields."""
    return (
        F.when(_missing(column("type")), TYPE_REQUIRED)
        .when(_missing(column("source")), SOURCE_REQUIRED)
        .when(column("data").isNull(), DATA_REQUIRED)
    )


def validate_http(df: DataFrame) -> DataFrame:
    return df.withColumn("error", http_error())


def validate_typed(df: DataFrame, present: str | None = None) -> DataFrame:
    """Adds `error`; a row whose boolean column `present` is not true is a nil event."""
    error = typed_error()
    if df.schema["data"].dataType == StringType():
        error = F.coalesce(error, F.when(~F.coalesce(is_object(to_variant(F.col("data"))), F.lit(False)), DATA_OBJECT))
    if present:
        error = F.when(~F.coalesce(F.col(present), F.lit(False)), NIL_EVENT).otherwise(error)
    return df.withColumn("error", error)


def validation_report(df: DataFrame) -> DataFrame:
    """Dry run: the first failure as a whole, then missing type and source once more by field."""
    def entry(when: Column, field: str, message: Column, code: str) -> Column:
        return F.when(
            when, F.struct(F.lit(field).alias("field"), message.alias("message"), F.lit(code).alias("code"))
        )

    first = typed_error()
    errors = F.array(
        entry(first.isNotNull(), "event", first, "VALIDATION_FAILED"),
        entry(_missing(F.col("type")), "type", F.lit(TYPE_REQUIRED), "REQUIRED_FIELD"),
        entry(_missing(F.col("source")), "source", F.lit(SOURCE_REQUIRED), "REQUIRED_FIELD"),
    )
    report = df.withColumn("errors", F.array_compact(errors))
    return report.withColumns(
        {"is_valid": F.size("errors") == 0, "warnings": F.array().cast("array<string>")}
    )


def with_defaults(df: DataFrame, always: bool = False) -> DataFrame:
    """Fill empty ids and times; `always` replaces them, as the HTTP side does."""
    if always:
        return df.withColumns({"id": new_id(), "timestamp": now_utc()})
    return df.withColumns(
        {
            "id": F.coalesce(blank_to_null(F.col("id")), new_id()),
            "timestamp": F.coalesce(F.col("timestamp"), now_utc()),
        }
    )


def with_request_id(df: DataFrame, column: str = "request_id") -> DataFrame:
    supplied = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.withColumn(column, F.coalesce(blank_to_null(supplied), new_id()))


def read_request_id(column: str = "request_id") -> Column:
    """What a handler sees: `unknown` where no id was set."""
    return F.coalesce(F.col(column), F.lit("unknown"))


def stamp_metadata(df: DataFrame, batch_index: str | None = None) -> DataFrame:
    """Put request id, client address, user agent (and batch index) into `metadata`, replacing such keys.

    Absent columns are empty, an absent request id is unknown.
    """
    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")

    request_id = read_request_id() if "request_id" in df.columns else F.lit("unknown")
    stamps = [
        F.lit("request_id"), request_id, F.lit("client_ip"), given("client_ip"), F.lit("user_agent"), given("user_agent"),
    ]
    names = STAMPED[:3]
    if batch_index:
        stamps += [F.lit("batch_index"), F.col(batch_index).cast("string")]
        names = STAMPED
    nothing = F.create_map().cast("map<string,string>")
    labels = F.coalesce("metadata", nothing) if "metadata" in df.columns else nothing
    kept = F.map_filter(labels, lambda key, _: ~key.isin(names))
    return df.withColumn("metadata", F.map_concat(kept, F.create_map(*stamps)))


def limit_size(df: DataFrame, max_size: str = "10MB", body: str = "body") -> DataFrame:
    """Adds `too_large`: the body has strictly more bytes than the limit."""
    return df.withColumn("too_large", F.octet_length(body) > parse_size(max_size))


def classify_outcome(
    df: DataFrame, rate_limited: str = "rate_limited", too_large: str = "too_large",
    error: str = "error", send_failed: str = "send_failed",
) -> DataFrame:
    """Outcome code in the order the checks happen; absent columns count as never failing."""
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)

    invalid = F.col(error).isNotNull() if error in df.columns else F.lit(False)
    return df.withColumn(
        "status_code",
        F.when(flag(rate_limited), TOO_MANY)
        .when(flag(too_large), TOO_LARGE)
        .when(invalid, BAD_REQUEST)
        .when(flag(send_failed), FAILED)
        .otherwise(ACCEPTED),
    )
