"""Queries: transforms, data quality, masking, tenants, reconciliation and anomalies."""

from pyspark.sql import functions as F

from eventspark.operators import ingest as I
from eventspark.operators import quality as Q
from eventspark.operators import validate as V
from eventspark.operators import windows as W
from eventspark.plans.catalog import query
from eventspark.plans.tables import ARRIVAL, STD


@query("SELECT event_id, upper(event_type) AS kind, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE value >= 50")
def transform_filter(t):
    exprs = {
        "event_id": F.col("event_id"), "kind": F.upper("event_type"),
        "k": F.try_variant_get(F.try_parse_json("props"), "$.k", "long"),
    }
    return Q.transform(t.events, exprs, where=F.col("value") >= 50)


@query(f"""
WITH std AS ({STD}), c AS (SELECT count(*) AS checked, count(*) FILTER (type = '') AS a, count(*) FILTER (source IS NULL) AS b,
  count(*) FILTER (data IS NULL) AS c, count(*) FILTER (NOT priority BETWEEN 0 AND 10) AS d, count(*) FILTER (NOT value BETWEEN 0 AND 100) AS e FROM std)
SELECT unnest(['has_type', 'has_source', 'has_data', 'priority_range', 'value_range']) AS check_name, checked, unnest([a, b, c, d, e]) AS failed FROM c""")
def quality_report(t):
    return Q.quality(t.std, {
        "has_type": F.col("type") != "", "has_source": F.col("source").isNotNull(), "has_data": F.col("data").isNotNull(),
        "priority_range": Q.priority_in_range(), "value_range": F.col("value").between(0, 100),
    })


@query(f"""
SELECT doc_id, regexp_replace(regexp_replace(text, '{Q.EMAIL}', '<email>', 'g'), '{Q.PHONE}', '<phone>', 'g') AS text FROM documents""")
def mask_pii(t):
    return Q.mask(t.table("documents"), ["text"]).select("doc_id", "text")


@query(f"WITH std AS ({STD}) SELECT id, tenant_id FROM std WHERE tenant_id = 'tenant-2'")
def tenant_rows(t):
    return Q.for_tenant(t.std, "tenant-2").select("id", "tenant_id")


@query(f"""
WITH std AS ({STD}), s AS (SELECT count(*) AS n, count(*) FILTER (type = '' OR source IS NULL OR data IS NULL) AS bad FROM std)
SELECT unnest(['received', 'accepted', 'rejected', 'unaccounted']) AS stage, unnest([n, n - bad, bad, 0]) AS row_count FROM s""")
def reconcile(t):
    accepted, rejected = I.split_valid(V.validate_typed(t.std))
    return Q.reconcile(t.std, accepted=accepted, rejected=rejected)


@query(f"""
WITH a AS (SELECT *, {ARRIVAL} AS arrival FROM events),
m AS (SELECT *, ts < max(ts) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS late FROM a),
s AS (SELECT count(*) AS n, count(*) FILTER (coalesce(late, false)) AS late FROM m)
SELECT unnest(['received', 'on_time', 'late', 'unaccounted']) AS stage, unnest([n, n - late, late, 0]) AS row_count FROM s""")
def reconcile_late(t):
    arrived = t.events.withColumn("arrival", F.expr(ARRIVAL))
    on_time, late = W.split_late(arrived, "user_id", "1h", ["arrival", "event_id"], ts="ts")
    return Q.reconcile(arrived, on_time=on_time, late=late)


@query("""
WITH w AS (SELECT *, avg(value) OVER f AS mean, stddev_samp(value) OVER f AS spread FROM events
  WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, round((value - mean) / spread, 4) AS z_score FROM w WHERE spread > 0 AND abs((value - mean) / spread) >= 2""")
def anomalies(t):
    found = Q.anomalies(t.events, "user_id", "value", 20, ["ts", "event_id"], threshold=2)
    return found.select("event_id", "user_id", F.round("z_score", 4).alias("z_score"))
