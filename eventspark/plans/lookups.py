"""Queries: enrichment, interval joins, traces and type correlation."""

from pyspark.sql import functions as F

from eventspark.operators import joins as J
from eventspark.plans.catalog import query
from eventspark.plans.tables import STD


@query("""
SELECT event_id, event_type, c_name, n_name FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def enrich_nation(t):
    customers = t.table("customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_nationkey")
    nations = t.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    enriched = J.enrich(J.enrich(t.events, customers, "user_id"), nations, "c_nationkey")
    return enriched.select("event_id", "event_type", "c_name", "n_name")


def _sides(t):
    a = t.events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    b = t.events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
    return a, b


PAIR = "a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR AND b.event_type = 'purchase'"


@query(f"""
SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, a.ts AS a_ts, b.ts AS b_ts FROM events a JOIN events b ON {PAIR}
WHERE a.event_type = 'view'""")
def interval_join_view_purchase(t):
    return J.interval_join(*_sides(t), "user_id", "6h")


@query(f"""
SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, a.ts AS a_ts, b.ts AS b_ts FROM events a LEFT JOIN events b ON {PAIR}
WHERE a.event_type = 'view'""")
def interval_join_left(t):
    return J.interval_join(*_sides(t), "user_id", "6h", how="left")


@query(f"""
WITH std AS ({STD}) SELECT correlation_id, arg_min(event_id, event_id) AS root_id, arg_max(event_id, event_id) AS last_id,
  count(*) AS event_count, min(timestamp) AS started_at, max(timestamp) AS ended_at,
  (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000 AS span_ms FROM std GROUP BY correlation_id""")
def trace_summary(t):
    return J.trace_summary(t.std, id_col="event_id")


@query(f"""
WITH std AS ({STD}) SELECT event_id, correlation_id, row_number() OVER w AS position, first_value(event_id) OVER w AS root_id,
  (epoch_us(timestamp) - epoch_us(first_value(timestamp) OVER w)) // 1000 AS since_root_ms FROM std
WINDOW w AS (PARTITION BY correlation_id ORDER BY timestamp, event_id)""")
def correlate_traces(t):
    placed = J.correlate(t.std, id_col="event_id")
    return placed.select("event_id", "correlation_id", "position", "root_id", "since_root_ms")


@query("""
WITH p AS (SELECT a.event_type AS type_a, b.event_type AS type_b, count(*) AS pairs FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR GROUP BY ALL),
n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), w AS (SELECT count(*) AS n FROM events)
SELECT type_a, type_b, pairs, round(pairs / w.n, 6) AS support, round(pairs / a.n, 6) AS confidence,
  round(pairs * CAST(w.n AS DOUBLE) / (a.n * b.n), 6) AS lift
FROM p JOIN n a ON a.event_type = type_a JOIN n b ON b.event_type = type_b CROSS JOIN w""")
def type_correlation(t):
    found = J.type_correlation(t.events, "user_id", "6h", ts="ts", type_col="event_type")
    return found.withColumns({c: F.round(c, 6) for c in ("support", "confidence", "lift")})
