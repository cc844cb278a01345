"""Small helpers on DataFrames for the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.session import materialise

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside drop their shuffle files when they end; what they keep is in checkpoints."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; the jobs that made it drop their shuffle files."""
    with short_shuffles(df.sparkSession):
        return materialise(df.select("*"))  # a query takes the setting when it is made


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Give Python workers at most so many rows at a time, which bounds what a batch of texts takes beside them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


#: Rows that one row becomes at a time.
REPEAT = 1 << 16


def repeated(df: DataFrame, times: str, name: str) -> DataFrame:
    """Each row `times` times (a column), with `name` counting from 0.

    First a row for each block of at most `REPEAT` copies, which are dealt out anew, then the copies of a block: no row
    holds an array as long as its count, and no task makes all copies of one row.
    """
    block = free_name(df, "copies_from")
    last = F.greatest(F.col(times), F.lit(1)) - 1
    blocks = df.where(F.col(times) > 0).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / REPEAT))))
    large = df.agg(F.max(times)).first()[0] or 0
    if large > REPEAT:
        blocks = blocks.repartition(partitions(df.sparkSession))
    first = F.col(block) * REPEAT
    return blocks.withColumn(name, F.explode(F.sequence(first, F.least(first + (REPEAT - 1), last)))).drop(block)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
