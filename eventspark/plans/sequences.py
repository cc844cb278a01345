"""Queries: patterns and admission control."""

from pyspark.sql import functions as F

from eventspark.operators import admission as A
from eventspark.operators import patterns as P
from eventspark.plans.catalog import query


def steps(*names):
    """Steps named and met by event types."""
    return [(name, F.col("event_type") == name) for name in names]


@query("""
WITH l AS (SELECT user_id, event_id, ts, event_type, lead(event_id, 1) OVER w AS id1, lead(event_type, 1) OVER w AS t1, lead(ts, 1) OVER w AS ts1,
  lead(event_id, 2) OVER w AS id2, lead(event_type, 2) OVER w AS t2, lead(ts, 2) OVER w AS ts2 FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS view_id, ts AS view_ts, id1 AS click_id, ts1 AS click_ts, id2 AS purchase_id, ts2 AS purchase_ts FROM l
WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase' AND ts2 - ts <= INTERVAL 24 HOUR""")
def match_strict_vcp(t):
    return P.match_strict(t.events, "user_id", steps("view", "click", "purchase"), "24h", ts="ts", id_col="event_id")


# Event ids follow time, so the next event of a kind is the one of the smallest later id.
RELAXED = """
WITH v AS (SELECT a.user_id, a.event_id AS view_id, a.ts AS view_ts,
    (SELECT min(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND b.event_id > a.event_id) AS click_id
  FROM events a WHERE a.event_type = 'view'),
c AS (SELECT v.*, (SELECT min(p.event_id) FROM events p WHERE p.user_id = v.user_id AND p.event_type = 'purchase' AND p.event_id > v.click_id) AS purchase_id FROM v)
SELECT c.user_id, view_id, view_ts, click_id, k.ts AS click_ts, purchase_id, p.ts AS purchase_ts FROM c
JOIN events k ON k.event_id = click_id JOIN events p ON p.event_id = purchase_id WHERE p.ts - view_ts <= INTERVAL 24 HOUR
"""


@query(RELAXED)
def match_relaxed_vcp(t):
    return P.match_relaxed(t.events, "user_id", steps("view", "click", "purchase"), "24h", ts="ts", id_col="event_id")


@query("""
WITH e AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS match_count
  FROM events WHERE event_type = 'error')
SELECT event_id, user_id, ts, match_count FROM e WHERE match_count >= 3""")
def fraud_threshold(t):
    found = P.match_threshold(t.events, "user_id", F.col("event_type") == "error", 3, "24h", ts="ts")
    return found.select("event_id", "user_id", "ts", "match_count")


@query("""
WITH i AS (SELECT a.user_id, a.event_id AS first_id, (SELECT min(b.event_id) FROM events b WHERE b.user_id = a.user_id
    AND b.event_type = 'click' AND b.event_id > a.event_id) AS last_id FROM events a WHERE a.event_type = 'view'),
m AS (SELECT i.user_id, concat(first_id, '>', last_id) AS id, b.ts FROM i JOIN events a ON a.event_id = first_id
  JOIN events b ON b.event_id = last_id WHERE b.ts - a.ts <= INTERVAL 6 HOUR),
n AS (SELECT m.*, (SELECT min(p.event_id) FROM events p WHERE p.user_id = m.user_id AND p.event_type = 'purchase' AND p.ts > m.ts) AS purchase_id FROM m)
SELECT n.user_id, n.id AS interest_id, n.ts AS interest_ts, CAST(purchase_id AS VARCHAR) AS purchase_id, p.ts AS purchase_ts
FROM n JOIN events p ON p.event_id = purchase_id WHERE p.ts - n.ts <= INTERVAL 24 HOUR""")
def match_nested_interest(t):
    inner, outer = steps("view", "click"), steps("interest", "purchase")
    return P.match_nested(
        t.events, "user_id", inner, "interest", outer, within="24h", inner_within="6h", ts="ts", id_col="event_id",
        type_col="event_type",
    )


@query("""
SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events""")
def fixed_window_limit(t):
    limited = A.fixed_window_limit(t.events, "event_type", 2, ts="ts", id_col="event_id", window="hour")
    return limited.select("event_id", "allowed")


# Micro-tokens, so that the walk adds the same numbers in both engines: one token per 50,000 seconds, burst 2.
@query("""
WITH RECURSIVE n AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w(event_id, user_id, us, rn, tokens, allowed) AS (
  SELECT event_id, user_id, us, rn, CAST(1000000 AS DOUBLE), true FROM n WHERE rn = 1
  UNION ALL
  SELECT n.event_id, n.user_id, n.us, n.rn,
    CASE WHEN least(2000000, w.tokens + (n.us - w.us) * 0.00002) >= 1000000 - 0.00000002 THEN least(2000000, w.tokens + (n.us - w.us) * 0.00002) - 1000000
      ELSE least(2000000, w.tokens + (n.us - w.us) * 0.00002) END,
    least(2000000, w.tokens + (n.us - w.us) * 0.00002) >= 1000000 - 0.00000002
  FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1)
SELECT event_id, allowed FROM w""")
def token_bucket(t):
    admitted = A.token_bucket(
        t.events.select("event_id", "user_id", "ts"), "user_id", rate=0.00002, burst=2, ts="ts", id_col="event_id"
    )
    return admitted.select("event_id", "allowed")
