"""Transforms, quality checks, masking, tenants, reconciliation and anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.operators.ordered import halo, split, without_halo

# Patterns of personal data.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ().-]{7,}\d"
MASKS = {"email": (EMAIL, "<email>"), "phone": (PHONE, "<phone>")}
# Fixed value: text a match must contain; its absence saves the search.
NEEDED = {"email": "@"}


def transform(df: DataFrame, exprs: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Filter, then project the named expressions."""
    kept = df if where is None else df.filter(where)
    return kept.select(*[value.alias(name) for name, value in exprs.items()])


def quality(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Per check: rows seen and rows failing it (a null outcome fails). One pass."""
    failing = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()]
    totals = df.agg(F.count(F.lit(1)).alias("checked"), *failing)
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("failed")) for n in checks])
    return totals.select("checked", F.inline(rows)).select("check_name", "checked", "failed")


def priority_in_range(column: str = "priority") -> Column:
    return F.col(column).between(0, 10)


def mask(df: DataFrame, cols: list[str], kinds: tuple[str, ...] = ("email", "phone")) -> DataFrame:
    """Replace personal data in text columns by a tag."""
    def replaced(text: Column, kind: str) -> Column:
        found = F.regexp_replace(text, *MASKS[kind])
        return F.when(text.contains(NEEDED[kind]), found).otherwise(text) if kind in NEEDED else found

    def masked(column: Column) -> Column:
        return reduce(replaced, kinds, column)

    return df.withColumns({c: masked(F.col(c)) for c in cols})


def pseudonym(column: str, salt: str) -> Column:
    """A stable stand-in for an identifier."""
    return F.sha2(F.concat(F.lit(salt), F.col(column)), 256)


def for_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of one tenant; None gives the rows without a tenant."""
    return df.filter(F.col("tenant_id").isNull() if tenant is None else F.col("tenant_id") == tenant)


def reconcile(received: DataFrame, **stages: DataFrame) -> DataFrame:
    """Rows received against the rows of every stage (accepted, rejected, late, ...), and what is unaccounted for."""
    counts = received.agg(F.lit("received").alias("stage"), F.count(F.lit(1)).alias("row_count"))
    for name, df in stages.items():
        counts = counts.unionByName(df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("row_count")))
    # One row per stage.
    balance = counts.agg(
        F.lit("unaccounted").alias("stage"),
        F.sum(F.when(F.col("stage") == "received", F.col("row_count")).otherwise(-F.col("row_count"))).alias("row_count"),
    )
    return counts.unionByName(balance)


def anomalies(
    df: DataFrame, key: str, value: str, n: int, order: list[str], threshold: float | None = None
) -> DataFrame:
    """Adds `z_score` of a value against the `n` rows of its key before it (null without any spread)."""
    rows = halo(split(df, [key], order), before=n)
    trailing = rows.window().rowsBetween(-n, -1)
    scored = rows.df.withColumns(
        {"_mean": F.avg(value).over(trailing), "_spread": F.stddev_samp(value).over(trailing)}
    )
    score = F.when(F.col("_spread") > 0, (F.col(value) - F.col("_mean")) / F.col("_spread"))
    scored = without_halo(scored.withColumn("z_score", score)).drop("_mean", "_spread")
    return scored if threshold is None else scored.filter(F.abs("z_score") >= threshold)
