"""Events as topic records: encoding, partition placement and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.text import blank_to_null, fnv1a32
from eventspark.operators.ordered import numbered, split
from eventspark.operators.sizes import is_small

# Fixed value: partitions of a topic unless told otherwise.
DEFAULT_PARTITIONS = 12
OPTIONAL_TEXT = ["subject", "tenant_id", "version", "schema_version", "correlation_id"]


def _rfc3339(ts: Column) -> Column:
    """UTC time text with the trailing zeros of the fraction removed."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0*$", ""), F.lit("Z"))


def record_value(df: DataFrame) -> Column:
    """The JSON of an event: empty optional fields are left out, the payload is always there."""
    def text(name: str) -> Column:
        return blank_to_null(F.col(name)) if name in df.columns else F.lit(None).cast("string")

    metadata = F.col("metadata") if "metadata" in df.columns else F.lit(None).cast("map<string,string>")
    priority = F.col("priority") if "priority" in df.columns else F.lit(None).cast("int")
    payload = F.coalesce(F.try_parse_json("data"), F.parse_json(F.lit("null")))
    return F.to_json(
        F.struct(
            F.coalesce("id", F.lit("")).alias("id"),
            F.coalesce("type", F.lit("")).alias("type"),
            F.coalesce("source", F.lit("")).alias("source"),
            text("subject").alias("subject"),
            text("tenant_id").alias("tenant_id"),
            payload.alias("data"),
            _rfc3339(F.col("timestamp")).alias("timestamp"),
            text("version").alias("version"),
            text("schema_version").alias("schema_version"),
            F.when(F.size(metadata) > 0, metadata).alias("metadata"),
            text("correlation_id").alias("correlation_id"),
            F.nullif(priority, F.lit(0)).alias("priority"),
        )
    )


def to_records(df: DataFrame, topic: str = "events") -> DataFrame:
    """Record per event: key is the type, value the JSON, three headers, the event's time."""
    def header(name: str, column: str) -> Column:
        value = F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")
        return F.struct(F.lit(name).alias("key"), value.alias("value"))

    return df.select(
        F.lit(topic).alias("topic"),
        F.col("type").alias("key"),
        record_value(df).alias("value"),
        F.array(header("event_id", "id"), header("event_type", "type"), header("source", "source")).alias("headers"),
        F.col("timestamp"),
    )


def placement(key: Column, n: int) -> Column:
    """Absolute value of the signed 32-bit hash modulo `n`."""
    sign = F.lit(2**31)
    signed = fnv1a32(key).bitwiseXOR(sign) - sign
    return F.abs(signed % n).cast("int")


def with_partition(df: DataFrame, n: int = DEFAULT_PARTITIONS, key: str = "key") -> DataFrame:
    """Adds `partition`. The hash runs once per distinct key while those are few, else per row."""
    if df.isStreaming:
        return df.withColumn("partition", placement(F.col(key), n))
    distinct = df.select(key).distinct()
    if not is_small(distinct):
        return df.withColumn("partition", placement(F.col(key), n))
    placed = distinct.select(F.col(key).alias("_key"), placement(F.col(key), n).alias("partition"))
    return df.join(F.broadcast(placed), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def with_offsets(
    df: DataFrame, arrival: list[str], base: DataFrame | None = None, partition: str = "partition"
) -> DataFrame:
    """Adds `offset`: dense per partition in arrival order, starting at `base(partition, base_offset)`.

    A topic has few partitions, so large ones are numbered block by block.
    """
    counted = numbered(split(df, [partition], arrival), "_n").result()
    start = F.lit(0).cast("long")
    if base is not None:
        # One row per topic partition.
        counted = counted.join(F.broadcast(base), partition, "left")
        start = F.coalesce("base_offset", start)
    result = counted.withColumn("offset", start + F.col("_n") - 1)
    return result.drop("_n", "base_offset")
