"""Dead letters: retries and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.clock import backoff

DEAD, RESOLVED, WAITING = "DEAD", "RESOLVED", "WAITING"


def dlq_due(dlq: DataFrame, now: Column) -> DataFrame:
    """Letters to retry now; those that a round has resolved or given up are done."""
    waiting = F.coalesce(F.col("state") == WAITING, F.lit(True)) if "state" in dlq.columns else F.lit(True)
    return dlq.filter(waiting & (F.col("retry_count") < F.col("max_retries")) & (F.col("next_retry_at") <= now))


def dlq_advance(dlq: DataFrame, outcomes: DataFrame, now: Column, base_seconds: float) -> DataFrame:
    """Letters after a retry round; `outcomes` holds `original_event_id` and `succeeded`.

    Adds `state`: RESOLVED, DEAD once retries are used up, else WAITING with a later `next_retry_at`. The result is
    the input of the next round: what is RESOLVED or DEAD stays so. Of several outcomes of a letter a success counts.
    """
    folded = outcomes.groupBy(F.col("original_event_id").alias("_id")).agg(F.bool_or(F.coalesce("succeeded", F.lit(False))).alias("succeeded"))
    columns = [c for c in dlq.columns if c != "state"]
    known = dlq if "state" in dlq.columns else dlq.withColumn("state", F.lit(None).cast("string"))
    tried = known.withColumnRenamed("state", "_state").join(folded, F.col("original_event_id") == F.col("_id"), "left")
    done = F.coalesce(F.col("_state").isin(RESOLVED, DEAD), F.lit(False))
    tried = tried.withColumn("succeeded", F.when(~done, F.col("succeeded")))
    failed = F.col("succeeded").isNotNull() & ~F.coalesce("succeeded", F.lit(False))
    count = F.col("retry_count") + F.when(failed, 1).otherwise(0)
    state = (
        F.when(done, F.col("_state")).when(F.col("succeeded"), RESOLVED).when(count >= F.col("max_retries"), DEAD).otherwise(WAITING)
    )
    next_at = F.when(state == WAITING, F.when(failed, backoff(now, count, base_seconds)).otherwise(F.col("next_retry_at")))
    changed = tried.select(
        *[c for c in columns if c not in ("retry_count", "next_retry_at", "updated_at")],
        count.alias("retry_count"), next_at.alias("next_retry_at"),
        F.when(F.col("succeeded").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
        state.alias("state"),
    )
    return changed.select(*columns, "state")


def dlq_summary(dlq: DataFrame) -> DataFrame:
    """Letters per error type, tenant and number of retries."""
    return dlq.groupBy("error_type", "tenant_id", "retry_count").agg(
        F.count(F.lit(1)).alias("letter_count"),
        F.count_if(F.col("retry_count") >= F.col("max_retries")).alias("exhausted_count"),
    )
