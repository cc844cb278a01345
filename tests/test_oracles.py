"""Every registered query gives the rows its SQL states, plainly and with every larger key cut into blocks."""

import pytest

import __spark_entry__ as entry
from comparison import connect, duck_rows, spark_rows
from eventspark.plans import all_queries, all_sql

QUERIES = all_queries()
SQL = all_sql()

# Queries built on the ordered core.
ORDERED = [
    "aggregate_by_type",
    "active_connections", "alert_for", "anomalies", "correlate_traces", "count_windows_10", "counter_rate",
    "fixed_window_limit", "fraud_threshold", "ingest_accepted", "ingest_batch_failfast", "late_rows", "lateness",
    "match_nested_interest", "match_relaxed_vcp", "match_strict_vcp", "notify_bulk", "notify_cap", "notify_status",
    "record_offsets", "schema_compat", "schema_lineage", "send_batch_stop", "sessions_6h", "token_bucket",
    "trend_alert", "type_correlation",
]


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    names, found = spark_rows(QUERIES[name](spark, small))
    assert (names, found) == duck_rows(duck, SQL[name])


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_hot_keys(spark, small, duck, cut, name):
    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(duck, SQL[name])


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry_adds_the_optional_part_only():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["window_start", "userId", "activity_count"]
