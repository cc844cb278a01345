"""Queries: logs, request metrics, counters, alerts and lag."""

from pyspark.sql import functions as F

from eventspark.operators import ingest as I
from eventspark.operators import observe as M
from eventspark.operators import validate as V
from eventspark.operators.ordered import numbered, split
from eventspark.plans.catalog import query
from eventspark.plans.ingestion import TYPED_ERROR
from eventspark.plans.tables import ALERTS, COUNTER, REQUESTS, STD
from eventspark.sources import parse_container_logs

# Container log lines; some have no tag, some no time, some are no JSON.
LINES = r"""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN concat('plain ', event_type) ELSE concat('{"log":"', event_type, ' done","stream":"',
  CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END, '"', CASE WHEN event_id % 10 = 1 THEN '' ELSE
  concat(',"time":"2024-01-01T00:00:', CAST(10 + event_id % 50 AS STRING), '.123456789Z"') END,
  ',"attrs":{"tag":"', CASE WHEN event_id % 10 = 2 THEN 'untagged' ELSE concat('svc-', CAST(user_id AS STRING), '|abc|def') END, '"}}') END AS value FROM events
"""


@query(f"""
WITH l AS ({LINES}), e AS (SELECT l.event_id, event_type, user_id FROM l JOIN events USING (event_id))
SELECT CASE WHEN event_id % 10 > 1 THEN TIMESTAMP '2024-01-01 00:00:10.123456' + INTERVAL 1 SECOND * (event_id % 50) END AS ts,
  CASE WHEN event_id % 10 > 0 THEN CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END END AS stream,
  CASE WHEN event_id % 10 NOT IN (0, 2) THEN concat('svc-', user_id) END AS container_name,
  CASE WHEN event_id % 10 > 0 THEN concat(event_type, ' done') END AS output, 'containerlogs' AS job FROM e""")
def container_logs(t):
    return parse_container_logs(t.view(LINES))


@query(f"""
WITH r AS ({REQUESTS}) SELECT method, endpoint, CAST(status AS VARCHAR) AS status, count(*) AS total FROM r GROUP BY ALL""")
def http_requests_total(t):
    return M.http_requests_total(t.requests)


BUCKETS = f"""
WITH r AS ({REQUESTS}), b AS (SELECT unnest([{', '.join(map(str, M.BUCKETS))}, CAST('inf' AS DOUBLE)]) AS le),
h AS (SELECT method, endpoint, le, count(*) FILTER (duration_seconds <= le) AS cumulative,
  CAST(sum(CAST(duration_seconds AS DECIMAL(38,9))) AS DOUBLE) AS duration_sum, count(*) AS duration_count FROM r CROSS JOIN b GROUP BY ALL)
"""


@query(BUCKETS + """
SELECT method, endpoint, CAST(le AS VARCHAR) AS le, cumulative, round(duration_sum, 6) AS duration_sum, duration_count FROM h""")
def latency_histogram(t):
    text = F.when(F.col("le") == M.INFINITY, "inf").otherwise(F.col("le").cast("string"))
    return M.http_request_duration(t.requests).withColumns({"le": text, "duration_sum": F.round("duration_sum", 6)})


@query(BUCKETS + """,
l AS (SELECT *, 0.9 * max(cumulative) OVER (PARTITION BY method, endpoint) AS r, coalesce(lag(le) OVER w, 0) AS lower, coalesce(lag(cumulative) OVER w, 0) AS below
  FROM h WINDOW w AS (PARTITION BY method, endpoint ORDER BY le))
SELECT method, endpoint, round(arg_min(CASE WHEN le = CAST('inf' AS DOUBLE) THEN lower ELSE lower + (le - lower) * (r - below) / (cumulative - below) END, le), 6) AS quantile_value
FROM l WHERE cumulative >= r GROUP BY method, endpoint""")
def latency_quantile(t):
    found = M.histogram_quantile(M.http_request_duration(t.requests), 0.9, ["method", "endpoint"])
    return found.withColumn("quantile_value", F.round("quantile_value", 6))


@query("""
WITH m AS (SELECT ts, 1 AS d FROM events UNION ALL SELECT ts + INTERVAL 1 MICROSECOND * CAST(round(value * 1000000) AS BIGINT), -1 FROM events),
c AS (SELECT ts, sum(d) AS d FROM m GROUP BY ts)
SELECT ts, CAST(sum(d) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM c""")
def active_connections(t):
    # Seconds instead of milliseconds, so that requests overlap.
    return M.active_connections(t.events.select("ts", F.col("value").alias("duration_seconds")))


@query(f"""
WITH std AS ({STD}) SELECT type AS event_type, source, count(*) AS total FROM std
WHERE type <> '' AND source IS NOT NULL AND data IS NOT NULL GROUP BY ALL""")
def events_ingested_total(t):
    accepted, _ = I.split_valid(V.validate_typed(t.std))
    return M.events_ingested_total(accepted)


@query(f"""
WITH std AS ({STD}), e AS (SELECT *, {TYPED_ERROR} AS reason FROM std)
SELECT type AS event_type, source, reason, count(*) AS total FROM e WHERE reason IS NOT NULL GROUP BY ALL""")
def events_failed_total(t):
    _, rejected = I.split_valid(V.validate_typed(t.std))
    return M.events_failed_total(rejected)


@query(f"""
WITH c AS ({COUNTER}), s AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY ts) AS b FROM c),
i AS (SELECT *, CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END AS step FROM s)
SELECT event_id, metric, round(sum(CAST(step AS DOUBLE)) OVER (PARTITION BY metric ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) / 21600, 6) AS rate
FROM i""")
def counter_rate(t):
    rates = M.rate(t.view(COUNTER), "6h", ["metric"])
    return rates.select("event_id", "metric", F.round("rate", 6).alias("rate"))


@query(f"""
WITH r AS ({REQUESTS}) SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS request_count,
  count(*) FILTER (status BETWEEN 500 AND 599) AS error_count, round(count(*) FILTER (status BETWEEN 500 AND 599) / 300, 6) AS errors_per_second,
  round(count(*) FILTER (status BETWEEN 500 AND 599) / count(*), 6) AS error_share FROM r GROUP BY 1""")
def error_rate(t):
    rates = M.error_rate(t.requests)
    return rates.withColumns({c: F.round(c, 6) for c in ("errors_per_second", "error_share")})


@query(f"WITH r AS ({REQUESTS}) SELECT endpoint, CAST(status // 100 AS INT) AS status_class, count(*) AS total FROM r GROUP BY ALL")
def status_classes(t):
    return M.status_classes(t.requests)


@query("""
WITH c AS (SELECT user_id, ts, value > 20 AS o FROM events), l AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY ts), false) AS was FROM c),
g AS (SELECT *, sum(CASE WHEN o AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM l)
SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS sample_count, min(ts) + INTERVAL 24 HOUR AS fired_at
FROM g WHERE o GROUP BY user_id, island HAVING max(ts) - min(ts) >= INTERVAL 24 HOUR""")
def alert_for(t):
    return M.alert_for(t.events, ["user_id"], F.col("value") > 20, "24h")


@query(f"""
WITH a AS ({ALERTS}) SELECT event_id FROM a WHERE NOT (severity = 'warning' AND EXISTS (SELECT 1 FROM a c WHERE c.severity = 'critical'
  AND c.alertname = a.alertname AND c.dev IS NOT DISTINCT FROM a.dev AND c.instance = a.instance))""")
def alert_inhibit(t):
    return M.inhibit(t.alerts).select("event_id")


# Critical alerts fire for twelve hours.
@query(f"""
WITH a AS ({ALERTS}) SELECT event_id FROM a WHERE NOT (severity = 'warning' AND EXISTS (SELECT 1 FROM a c WHERE c.severity = 'critical'
  AND c.alertname = a.alertname AND c.dev IS NOT DISTINCT FROM a.dev AND c.instance = a.instance AND c.ts <= a.ts AND a.ts < c.ts + INTERVAL 12 HOUR))""")
def alert_inhibit_while(t):
    return M.inhibit_while(t.alerts.withColumn("until", F.expr("ts + INTERVAL 12 HOURS")), "until").select("event_id")


# The declared alerts, with windows and limits for as few requests as the tables have: six hours at every full hour.
TICKS = f"""
WITH r AS ({REQUESTS}), s AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR * k AS tick FROM r CROSS JOIN (SELECT unnest(range(1, 7)) AS k)),
"""
STRETCHES = """
g AS (SELECT *, sum(CASE WHEN high AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY method, endpoint, status ORDER BY tick) AS island
  FROM (SELECT *, lag(high) OVER w AND tick - lag(tick) OVER w <= INTERVAL 1 HOUR AS was FROM c WINDOW w AS (PARTITION BY method, endpoint, status ORDER BY tick)))
SELECT method, endpoint, status, min(tick) AS started_at, max(tick) AS ended_at, count(*) AS sample_count FROM g WHERE high
GROUP BY method, endpoint, status, island HAVING max(tick) - min(tick) >= INTERVAL 2 HOUR
"""


@query(TICKS + """
c AS (SELECT method, endpoint, CAST(status AS VARCHAR) AS status, tick, count(*) / 21600 > 0.00008 AS high FROM s WHERE status BETWEEN 500 AND 599 GROUP BY ALL),""" + STRETCHES)
def alert_error_rate(t):
    found = M.high_error_rate(t.requests, window="6h", threshold=0.00008, lasting="2h", slide="1h")
    return found.select("method", "endpoint", "status", "started_at", "ended_at", "sample_count")


@query(TICKS + f"""
b AS (SELECT unnest([{', '.join(map(str, M.BUCKETS))}, CAST('inf' AS DOUBLE)]) AS le),
h AS (SELECT method, endpoint, tick, le, count(*) FILTER (duration_seconds <= le) AS cumulative FROM s CROSS JOIN b GROUP BY ALL),
l AS (SELECT *, 0.99 * max(cumulative) OVER (PARTITION BY method, endpoint, tick) AS r, coalesce(lag(le) OVER w, 0) AS lower, coalesce(lag(cumulative) OVER w, 0) AS below
  FROM h WINDOW w AS (PARTITION BY method, endpoint, tick ORDER BY le)),
c AS (SELECT method, endpoint, CAST(NULL AS VARCHAR) AS status, tick, arg_min(CASE WHEN le = CAST('inf' AS DOUBLE) THEN lower ELSE lower + (le - lower) * (r - below) / (cumulative - below) END, le) > 0.1 AS high
  FROM l WHERE cumulative >= r AND cumulative > 0 GROUP BY method, endpoint, tick),""" + STRETCHES)
def alert_latency(t):
    found = M.high_latency(t.requests, window="6h", lasting="2h", slide="1h")
    return found.select("method", "endpoint", F.lit(None).cast("string").alias("status"), "started_at", "ended_at", "sample_count")


# A group's flush times: 10 minutes after its first alert and every 10 minutes from there; known alerts again after 6 hours.
def _flushes(alerts: str) -> str:
    return f"""
WITH RECURSIVE a AS ({alerts}), g AS (SELECT *, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY alertname)) - 600000000 AS past,
    min(ts) OVER (PARTITION BY alertname) AS begun FROM a),
k AS (SELECT *, greatest(CAST(ceil(past / 600000000.0) AS BIGINT), 0) AS tick FROM g),
f AS (SELECT *, min(tick) OVER (PARTITION BY alertname, severity, dev, instance) AS first FROM k),
s AS (SELECT alertname, begun, tick, count(DISTINCT CASE WHEN tick = first THEN concat(severity, '|', coalesce(dev, ''), '|', instance) END) AS fresh_alerts,
    count(*) AS alert_count FROM f GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY alertname ORDER BY tick) AS rn FROM s),
w(alertname, rn, last, reason) AS (SELECT alertname, rn, tick, 'new' FROM n WHERE rn = 1
  UNION ALL SELECT n.alertname, n.rn, CASE WHEN n.fresh_alerts > 0 OR n.tick - w.last >= 36 THEN n.tick ELSE w.last END,
    CASE WHEN n.fresh_alerts > 0 THEN 'new' WHEN n.tick - w.last >= 36 THEN 'repeat' END
  FROM w JOIN n ON n.alertname = w.alertname AND n.rn = w.rn + 1)
SELECT n.alertname, begun + INTERVAL 10 MINUTE * (n.tick + 1) AS notified_at, fresh_alerts, alert_count, reason
FROM w JOIN n ON n.alertname = w.alertname AND n.rn = w.rn WHERE reason IS NOT NULL"""


@query(_flushes(ALERTS))
def alert_groups(t):
    return M.group_alerts(t.alerts, wait="10m", interval="10m", repeat="6h")


# Some alerts have no name; the query has them as null, its result as the empty text.
UNNAMED = ALERTS.replace("event_type AS alertname", "CASE WHEN event_type <> 'view' THEN event_type END AS alertname")


@query(_flushes(UNNAMED.replace("CASE WHEN event_type <> 'view' THEN event_type END", "CASE WHEN event_type <> 'view' THEN event_type ELSE '' END")))
def alert_groups_unnamed(t):
    return M.group_alerts(t.view(UNNAMED), wait="10m", interval="10m", repeat="6h")


@query("""
WITH d AS (SELECT *, (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS day FROM events),
r AS (SELECT event_id, user_id, count(*) OVER f AS n, regr_slope(value, day) OVER f AS slope FROM d
  WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, round(slope, 3) AS slope_per_day, slope > 0 AS rising FROM r WHERE n > 2""")
def trend_alert(t):
    fitted = M.trend_alert(t.events, ["user_id"], 10, 1000.0, ["ts", "event_id"])
    # Two points or fewer are left out.
    placed = numbered(split(fitted, ["user_id"], ["ts", "event_id"]), "n").result().filter("n > 2")
    return placed.select(
        "event_id", "user_id", F.round("slope_per_day", 3).alias("slope_per_day"), (F.col("slope_per_day") > 0).alias("rising")
    )


@query("""
WITH e AS (SELECT CAST(event_id % 12 AS INT) AS partition, count(*) AS end_offset FROM events GROUP BY 1),
c AS (SELECT CAST(event_id % 12 AS INT) AS partition, count(*) AS committed_offset FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_id % 12 <> 5 GROUP BY 1)
SELECT partition, end_offset, committed_offset, greatest(end_offset - coalesce(committed_offset, 0), 0) AS lag FROM e LEFT JOIN c USING (partition)""")
def consumer_lag(t):
    topic = t.events.withColumn("partition", (F.col("event_id") % 12).cast("int"))
    ends = topic.groupBy("partition").agg(F.count(F.lit(1)).alias("end_offset"))
    done = topic.filter("ts < TIMESTAMP '2024-01-20' AND partition <> 5").groupBy("partition")
    return M.consumer_lag(ends, done.agg(F.count(F.lit(1)).alias("committed_offset")))
