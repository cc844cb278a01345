"""Event history, results, dead letters, routed outputs and archive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.operators import id_filter
from eventspark.operators.sizes import is_small
from eventspark.schema import DEAD_LETTERS, EVENTS_TABLE
from eventspark.session import materialise
from eventspark.sources.history import MONTH, month_of

# Ages in days up to which an event is hot, then warm; older ones are cold.
HOT_DAYS, WARM_DAYS = 7, 90
MAX_RETRIES = 3
# Active outputs put into one plan; more are handled in further passes.
OUTPUTS_PER_PASS = 500
ROUTED = "config_name string, sink_type string, sink_config string, payload string"


def _write_by_month(df: DataFrame, ts: str, path: str, mode: str) -> None:
    # Rebalancing splits a month that holds much of the data and merges small ones.
    by_month = df.withColumn(MONTH, month_of(ts)).hint("rebalance", F.col(MONTH))
    by_month.write.mode(mode).partitionBy(MONTH).option("compression", "zstd").parquet(path)


def _exists(df: DataFrame, path: str) -> bool:
    """Whether a table was written at `path` before."""
    try:
        df.sparkSession.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise
    return True


def to_history(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Events as rows of the history table; `partition`, `offset` become its offset information."""
    now = F.current_timestamp() if now is None else now
    place = [c for c in ("partition", "offset") if c in df.columns]
    return df.select(
        F.col("id").alias("event_id"),
        F.col("tenant_id"),
        F.col("type").alias("event_type"),
        F.coalesce("data", F.lit("{}")).alias("event_data"),
        F.col("timestamp").alias("event_timestamp"),
        now.alias("processing_timestamp"),
        F.col("type").alias("partition_key"),
        (F.to_json(F.struct(*place)) if place else F.lit(None).cast("string")).alias("offset_info"),
        now.alias("created_at"),
    )


def new_events(df: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows whose `event_id` is not stored yet, one per id. Rows without an id are not events of a history.

    A counted-small arrival is broadcast against the stored ids, so the history is not shuffled for it.
    """
    df = df.filter("event_id IS NOT NULL")
    fresh = df.dropDuplicates(["event_id"])
    if stored is None:
        return fresh
    known = stored.select("event_id")
    arriving = df.select("event_id").distinct()
    if is_small(arriving):
        known = known.join(F.broadcast(arriving), "event_id", "left_semi").distinct()
    return fresh.join(known, "event_id", "left_anti").select(*df.columns)


def append_events(df: DataFrame, path: str, within_month: bool = False) -> DataFrame:
    """Append history rows to the month-partitioned table, skipping ids already there.

    A Bloom filter per month (see `id_filter`) tells which ids may be there; the history is read for those only, in
    the months that may have them, and not at all if there are none. A table without a filter gets one first.
    Returns the rows without an id, which the table can't hold.
    `within_month` looks only at the months that arrive: enough where a repeated event keeps its time,
    as in a replay.
    """
    now = F.current_timestamp()
    df = df.withColumns(
        {
            "processing_timestamp": F.coalesce("processing_timestamp", now),
            "created_at": F.coalesce("created_at", now),
        }
    ).select(*EVENTS_TABLE.names)
    spark = df.sparkSession
    arriving = df.filter("event_id IS NOT NULL").select("event_id", month_of("event_timestamp").alias(MONTH))
    stored = None
    if _exists(df, path):
        if not id_filter.has_filter(spark, path):
            id_filter.add_ids(spark.read.parquet(path).select("event_id", MONTH), path)
        # One value per month.
        months = [r[0] for r in arriving.select(MONTH).distinct().collect()] if within_month else None
        maybe = materialise(id_filter.maybe_stored(arriving.select("event_id").distinct(), path, months))
        there = [r[0] for r in maybe.select(MONTH).distinct().collect()]
        if there:
            stored = _looked_up(spark.read.parquet(path).filter(id_filter.in_months(there)), maybe)
    id_filter.add_ids(arriving, path)
    _write_by_month(new_events(df, stored), "event_timestamp", path, "append")
    return df.filter("event_id IS NULL")


def _looked_up(history: DataFrame, maybe: DataFrame) -> DataFrame:
    """The ids of `maybe` that the history has."""
    ids = maybe.select("event_id").distinct()
    return history.select("event_id").join(F.broadcast(ids) if is_small(ids) else ids, "event_id", "left_semi")


def archive(df: DataFrame, path: str, ts: str = "event_timestamp") -> None:
    """Cold archive: month-partitioned, zstd-compressed Parquet."""
    _write_by_month(df, ts, path, "append")


def to_dlq(rejected: DataFrame, now: Column | None = None, details: Column | None = None) -> DataFrame:
    """Rejected events as dead letters with the original event as JSON.

    Takes what `ingest` rejects; of id, tenant and error columns those that are absent are null.
    """
    now = F.current_timestamp() if now is None else now
    skip = {"error", "error_type", "error_message", "error_details", "status"}
    original = F.to_json(F.struct(*[F.col(c) for c in rejected.columns if c not in skip]))
    def given(name: str) -> Column:
        return F.col(name) if name in rejected.columns else F.lit(None).cast("string")

    letters = rejected.select(
        given("id").alias("original_event_id"),
        given("tenant_id").alias("tenant_id"),
        given("error_type").alias("error_type"),
        given("error_message").alias("error_message"),
        (F.lit(None).cast("string") if details is None else details).alias("error_details"),
        F.lit(0).alias("retry_count"),
        F.lit(MAX_RETRIES).alias("max_retries"),
        now.alias("next_retry_at"),
        original.alias("original_event_data"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return letters.select(*DEAD_LETTERS.names)


def to_processed(
    matches: DataFrame, rule_id: Column, result_type: Column, event_id: str = "id", now: Column | None = None
) -> DataFrame:
    """Matches as rows of the result table; columns other than id and tenant go into the result JSON."""
    now = F.current_timestamp() if now is None else now
    rest = [F.col(c) for c in matches.columns if c not in (event_id, "tenant_id")]
    tenant = F.col("tenant_id") if "tenant_id" in matches.columns else F.lit(None).cast("string")
    return matches.select(
        F.col(event_id).cast("string").alias("original_event_id"),
        tenant.alias("tenant_id"),
        rule_id.alias("rule_id"),
        result_type.alias("result_type"),
        F.to_json(F.struct(*rest)).alias("result_data"),
        now.alias("processing_timestamp"),
        now.alias("created_at"),
    )


def route(df: DataFrame, output_configs: DataFrame) -> DataFrame:
    """Each result once per active output that takes its `result_type`, as a payload row.

    An output's `sink_config` may list `result_types`; without the list it takes all. Outputs are
    configuration, so they become constants of one pass over the results.
    """
    outputs = output_configs.filter("is_active").select(
        "config_name", "sink_type", "sink_config",
        F.from_json(F.get_json_object("sink_config", "$.result_types"), "array<string>").alias("types"),
    ).orderBy("config_name").toLocalIterator()
    passes, chunk = [], []

    def one_pass(configs) -> DataFrame:
        entries = F.array(*[
            F.struct(
                F.lit(c.config_name).alias("config_name"), F.lit(c.sink_type).alias("sink_type"),
                F.lit(c.sink_config).alias("sink_config"),
                F.lit(c.types).cast("array<string>").alias("types"),
            )
            for c in configs
        ])
        wanted = F.filter(
            entries, lambda e: e["types"].isNull() | F.array_contains(e["types"], F.col("result_type"))
        )
        return df.withColumn("_output", F.explode(wanted)).select(
            "_output.config_name", "_output.sink_type", "_output.sink_config",
            F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("payload"),
        )

    for config in outputs:
        if not config.sink_type:
            raise ValueError(f"output {config.config_name} has no sink type")
        chunk.append(config)
        if len(chunk) == OUTPUTS_PER_PASS:
            passes.append(one_pass(chunk))
            chunk = []
    if chunk:
        passes.append(one_pass(chunk))
    if not passes:
        return df.sparkSession.createDataFrame([], ROUTED)
    return reduce(DataFrame.unionByName, passes)


def write_routes(routed: DataFrame, root: str, writers: dict[str, Callable[[DataFrame, str], None]] | None = None) -> None:
    """Write routed payloads, one sub-folder per output; `writers` by sink type replace the file sink.

    HTTP-like outputs are left as payload tables for a sender outside Spark.
    """
    writers = writers or {}
    for sink_type, write in writers.items():
        write(routed.filter(F.col("sink_type") == sink_type), f"{root}/{sink_type}")
    taken = F.coalesce(F.col("sink_type").isin(list(writers)), F.lit(False)) if writers else F.lit(False)
    rest = routed.filter(~taken)
    rest.hint("rebalance", F.col("config_name")).write.mode("append").partitionBy("config_name").parquet(root)


def assign_tier(df: DataFrame, now: Column, ts: str = "timestamp") -> DataFrame:
    """Adds `tier` by age: hot, warm or cold."""
    age = F.unix_micros(now) - F.unix_micros(ts)
    day = 86_400_000_000
    return df.withColumn(
        "tier", F.when(age <= HOT_DAYS * day, "hot").when(age <= WARM_DAYS * day, "warm").otherwise("cold")
    )


def tier_summary(df: DataFrame, now: Column, ts: str = "timestamp") -> DataFrame:
    """Events and their time range per tier: what may move or be dropped."""
    return assign_tier(df, now, ts).groupBy("tier").agg(
        F.count(F.lit(1)).alias("event_count"), F.min(ts).alias("oldest"), F.max(ts).alias("newest")
    )


def with_original(processed: DataFrame, events: DataFrame) -> DataFrame:
    """Results with the event they came from; results whose event is gone are kept."""
    return processed.join(
        events.withColumnRenamed("tenant_id", "event_tenant_id"),
        processed["original_event_id"] == events["event_id"], "left",
    )


def dlq_missing(rejected: DataFrame, dlq: DataFrame, event_id: str = "id") -> DataFrame:
    """Rejected events that have no dead letter yet."""
    return rejected.join(dlq, rejected[event_id] == dlq["original_event_id"], "left_anti")
