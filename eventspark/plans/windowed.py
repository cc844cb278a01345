"""Queries: windows, sessions, late rows, deduplication and rollups."""

from pyspark.sql import functions as F

from eventspark.operators import rollups as R
from eventspark.operators import windows as W
from eventspark.plans.catalog import query
from eventspark.plans.tables import ARRIVAL, STD, USER_EVENTS


def _exact(df):
    """Values as decimals, so that sums do not depend on the order of rows."""
    return df.withColumn("exact", F.col("value").cast("decimal(18,2)"))


@query("""
SELECT date_trunc('hour', ts) AS window_start, CAST(user_id AS VARCHAR) AS userId, count(*) AS activity_count
FROM events GROUP BY ALL""")
def user_activity_hourly(t):
    return W.user_activity(t.view(USER_EVENTS)).drop("window_end")


@query("""
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
  count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(value) AS low, max(value) AS high
FROM events GROUP BY ALL""")
def tumbling_daily(t):
    df = _exact(t.events)
    aggs = {"n": ("count",), "total": ("sum", "exact"), "low": ("min", "value"), "high": ("max", "value")}
    daily = W.tumbling(df, "1d", ["event_type"], aggs, ts="ts")
    return daily.withColumn("total", F.col("total").cast("double"))


@query("""
WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, max(value) AS high FROM w GROUP BY ALL""")
def sliding_counts(t):
    aggs = {"n": ("count",), "high": ("max", "value")}
    return W.sliding(t.events, "1h", "30m", ["event_type"], aggs, ts="ts")


@query("""
WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS window_start FROM events)
SELECT window_start, event_type, round(stddev_samp(value), 4) AS spread FROM w GROUP BY ALL""")
def sliding_spread(t):
    spreads = W.sliding(t.events, "1d", "12h", ["event_type"], {"spread": ("stddev", "value")}, ts="ts")
    return spreads.select("window_start", "event_type", F.round("spread", 4).alias("spread"))


ISLANDS = """
WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
"""


@query(ISLANDS + """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS event_count
FROM s GROUP BY user_id, island""")
def sessions_6h(t):
    return W.sessions(t.events, "6h", "user_id", ts="ts", tie="event_id")


@query("""
WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS window_index FROM events)
SELECT user_id, window_index, count(*) AS event_count, count(*) = 10 AS complete, max(value) AS high FROM n GROUP BY user_id, window_index""")
def count_windows_10(t):
    return W.count_windows(t.events, 10, "user_id", ["ts", "event_id"], {"high": ("max", "value")})


ARRIVED = f"""
WITH a AS (SELECT *, {ARRIVAL} AS arrival FROM events),
m AS (SELECT *, max(ts) OVER (PARTITION BY event_type ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_seen FROM a)
"""


@query(ARRIVED + "SELECT event_id, coalesce(ts < max_seen - INTERVAL 1 HOUR, false) AS is_late FROM m")
def late_rows(t):
    arrived = t.events.withColumn("arrival", F.expr(ARRIVAL))
    return W.mark_late(arrived, "event_type", "1h", ["arrival", "event_id"], ts="ts").select("event_id", "is_late")


@query(ARRIVED + "SELECT event_id FROM m WHERE ts < max_seen - INTERVAL 1 HOUR")
def late_side_output(t):
    arrived = t.events.withColumn("arrival", F.expr(ARRIVAL))
    _, late = W.split_late(arrived, "event_type", "1h", ["arrival", "event_id"], ts="ts")
    return late.select("event_id")


@query(ARRIVED + """
SELECT event_id, max_seen, coalesce(greatest((epoch_us(max_seen) - epoch_us(ts)) // 1000, 0), 0) AS lateness_ms FROM m""")
def lateness(t):
    arrived = t.events.withColumn("arrival", F.expr(ARRIVAL))
    measured = W.lateness(arrived, "event_type", ["arrival", "event_id"], ts="ts")
    return measured.select("event_id", "max_seen", "lateness_ms")


@query(f"""
WITH d AS (SELECT *, {ARRIVAL} AS arrival, user_id * 1000 + event_id % 97 AS dedupe_id FROM events)
SELECT dedupe_id, arg_min(event_id, (arrival, event_id)) AS event_id FROM d GROUP BY dedupe_id""")
def dedupe_events(t):
    # Ids made to collide; the copy that arrives first stays.
    arrived = t.events.withColumns({
        "arrival": F.expr(ARRIVAL), "dedupe_id": F.expr("user_id * 1000 + event_id % 97"),
    })
    return W.dedupe(arrived, "dedupe_id", ["arrival", "event_id"]).select("dedupe_id", "event_id")


@query(f"""
WITH std AS ({STD}) SELECT date_trunc('day', timestamp) AS window_start, tenant_id, count(*) AS event_count,
  count(DISTINCT type) AS type_count FROM std GROUP BY ALL""")
def tenant_usage(t):
    return W.tenant_usage(t.std).drop("window_end")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, round(avg(value), 4) AS mean,
  min(value) AS low, max(value) AS high, round(stddev_samp(value), 4) AS spread, round(quantile_cont(value, 0.9), 4) AS p90
FROM events GROUP BY event_type""")
def aggregate_by_type(t):
    aggs = {
        "n": ("count",), "total": ("sum", "exact"), "mean": ("avg", "value"), "low": ("min", "value"),
        "high": ("max", "value"), "spread": ("stddev", "value"), "p90": ("percentile", "value", 0.9),
    }
    stats = W.aggregate(_exact(t.events), ["event_type"], aggs)
    return stats.withColumns({
        "total": F.col("total").cast("double"), **{c: F.round(c, 4) for c in ("mean", "spread", "p90")},
    })


@query("""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS high FROM events GROUP BY ALL""")
def rollup_hourly(t):
    # The rollup of the first half, brought up to date with the second.
    df = _exact(t.events)
    aggs = {"n": ("count",), "total": ("sum", "exact"), "high": ("max", "value")}
    middle = "ts < TIMESTAMP '2024-01-16 00:30:00'"
    stored = W.partial_rollup(df.filter(middle), "1h", ["event_type"], aggs, ts="ts")
    merged = W.maintain_rollup(df.filter(f"NOT {middle}"), stored, "1h", ["event_type"], aggs, ts="ts")
    return merged.withColumn("total", F.col("total").cast("double")).drop("window_end")


@query("""
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total, round(stddev_samp(value), 3) AS spread,
  TRUE AS p90_is_close, TRUE AS users_are_close FROM events GROUP BY ALL""")
def rollup_sketches(t):
    # Hourly rollups of two halves, merged, then made daily; sketched figures are held against exact ones.
    aggs = {"n": ("count",), "mean": ("avg", "value"), "spread": ("stddev", "value"), "p90": ("percentile", "value", 0.9), "users": ("distinct", "user_id")}
    keys, half = ["event_type"], "event_id % 2 = 0"
    stored = R.partial_rollup(t.events.filter(half), "1h", keys, aggs, ts="ts")
    hourly = R.maintain_rollup(t.events.filter(f"NOT {half}"), stored, "1h", keys, aggs, ts="ts")
    daily = R.rollup_values(R.coarsen(hourly, "1d", keys, aggs), keys, aggs)
    rows = t.events.select(F.date_trunc("day", "ts").alias("window_start"), "event_type", "value", "user_id")
    share = lambda test: F.avg(test.cast("double"))
    held = rows.join(daily, ["window_start", *keys]).groupBy(*daily.columns).agg(
        share(F.col("value") < F.col("p90")).alias("below"), share(F.col("value") <= F.col("p90")).alias("upto"), F.countDistinct("user_id").alias("exact"))
    # The quantile of a sketch is one of the values: its ranks may pass the wanted one by one value more.
    far = F.greatest(F.col("below") - 0.9, 0.9 - F.col("upto")) - 1 / F.col("n")
    return held.select(
        "window_start", "event_type", "n", F.round(F.col("mean") * F.col("n"), 2).alias("total"), F.round("spread", 3).alias("spread"),
        (far <= 2 * R.KLL_RANK_ERROR).alias("p90_is_close"), (F.abs(F.col("users") - F.col("exact")) <= 4 * R.HLL_ERROR * F.col("exact")).alias("users_are_close"))


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts
FROM events GROUP BY user_id""")
def latest_state(t):
    return W.latest_state(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "ts")
