"""The list of queries, filled by the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import TimestampType

from eventspark.plans.tables import Tables

MODULES = ["ingestion", "history", "windowed", "sequences", "lookups", "configured", "checked", "observed", "notified"]

_RUN: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables under its own name."""
    def register(function: Callable[[Tables], DataFrame]):
        _RUN[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"eventspark.plans.{name}")


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone (UTC), as the tables have them."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampType)]
    return df.withColumns({name: df[name].cast("timestamp_ntz") for name in zoned}) if zoned else df


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def runner(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
            return _plain(function(Tables(spark, sf_dir)))

        return run

    return {name: runner(function) for name, function in _RUN.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
