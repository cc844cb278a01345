"""Registered queries over the given tables, each with the SQL that states its result."""

from eventspark.plans.catalog import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
