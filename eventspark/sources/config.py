"""Active configuration rows: schemas, rules, outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_active(df: DataFrame, name_col: str, version_col: str) -> DataFrame:
    """The highest active version of every name."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.filter("is_active").groupBy(name_col).agg(F.max_by(row, version_col).alias("_row"))
    return best.select("_row.*")
