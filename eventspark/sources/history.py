"""Event history on Parquet, partitioned by month, and replay."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eventspark.schema import EVENTS_TABLE

MONTH = "event_month"


def month_of(ts: str):
    """The UTC month of an instant, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")


def _utc(moment: datetime) -> datetime:
    """A bound in UTC; without a zone it is UTC already."""
    return (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)


def _instant(moment: datetime) -> Column:
    """A literal that doesn't depend on the zone of the driver or the session."""
    return F.timestamp_micros(F.lit((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)))


def history_range(
    df: DataFrame, start: datetime | None = None, end: datetime | None = None,
    tenant: str | None = None, types: list[str] | None = None,
) -> DataFrame:
    """History rows in `[start, end)` of a tenant and of given types.

    Bounds without a zone are UTC. On a month-partitioned table the time range also prunes months; the rest is pushed to the files.
    """
    by_month = MONTH in df.columns
    if start is not None:
        start = _utc(start)
        df = df.filter(F.col("event_timestamp") >= _instant(start))
        df = df.filter(F.col(MONTH) >= f"{start:%Y-%m}") if by_month else df
    if end is not None:
        end = _utc(end)
        df = df.filter(F.col("event_timestamp") < _instant(end))
        df = df.filter(F.col(MONTH) <= f"{end:%Y-%m}") if by_month else df
    if tenant is not None:
        df = df.filter(F.col("tenant_id") == tenant)
    if types:
        df = df.filter(F.col("event_type").isin(types))
    return df


def scan_events(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None,
    tenant: str | None = None, types: list[str] | None = None,
) -> DataFrame:
    """`history_range` of the table at `path`."""
    months = StructType([*EVENTS_TABLE.fields, StructField(MONTH, StringType())])
    return history_range(spark.read.schema(months).parquet(path), start, end, tenant, types)


def replay(df: DataFrame, from_, to, by: str = "offset") -> DataFrame:
    """Rows with `from_ <= x < to` in order; `by` is `offset` (per partition) or `timestamp`.

    By offset, rows are laid out by (partition, offset) range so a large topic partition is not one task.
    """
    chosen = df.filter((F.col(by) >= F.lit(from_)) & (F.col(by) < F.lit(to)))
    order = ["partition", "offset"] if by == "offset" else ["timestamp", "partition", "offset"]
    order = [c for c in order if c in df.columns]
    return chosen.repartitionByRange(*order).sortWithinPartitions(*order)
