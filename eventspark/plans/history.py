"""Queries: history, results, dead letters, routing and tiers."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from eventspark.operators import dlq as D
from eventspark.operators import ingest as I
from eventspark.operators import store as S
from eventspark.operators import validate as V
from eventspark.plans.catalog import query
from eventspark.plans.ingestion import TYPED_ERROR
from eventspark.plans.tables import NOW, STD
from eventspark.session import materialise
from eventspark.sources import history_range, replay
from eventspark.sources.history import MONTH, month_of

NOW_SQL = "TIMESTAMP '2024-02-01'"


def _now():
    return F.lit(NOW).cast("timestamp")


def _history(t):
    return S.to_history(t.std, _now())


@query(f"""
WITH std AS ({STD}) SELECT id AS event_id, type AS event_type, timestamp AS event_timestamp, {NOW_SQL} AS created_at
FROM std WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-20' AND tenant_id = 'tenant-1'
  AND type IN ('view', 'click')""")
def history_scan(t):
    rows = history_range(_history(t), datetime(2024, 1, 10), datetime(2024, 1, 20), "tenant-1", ["view", "click"])
    return rows.select("event_id", "event_type", "event_timestamp", "created_at")


@query(f"""
WITH std AS ({STD}) SELECT id AS event_id, type AS event_type FROM std WHERE timestamp >= TIMESTAMP '2024-01-16'""")
def history_append(t):
    # Everything arrives twice, and the first half of the month is stored already.
    history = _history(t)
    stored = history_range(history, end=datetime(2024, 1, 16))
    return S.new_events(history.unionByName(history), stored).select("event_id", "event_type")


@query(f"""
WITH std AS ({STD}) SELECT id AS event_id, timestamp + INTERVAL 2 DAY AS event_timestamp FROM std
WHERE timestamp + INTERVAL 2 DAY >= TIMESTAMP '2024-01-31 18:00:00' AND timestamp + INTERVAL 2 DAY < TIMESTAMP '2024-02-01 04:30:00'""")
def history_zone_range(t):
    # Bounds with a zone, whose own month differs from the UTC month of the rows.
    later = _history(t).withColumn("event_timestamp", F.col("event_timestamp") + F.expr("INTERVAL 2 DAY"))
    east, west = timezone(timedelta(hours=9)), timezone(timedelta(hours=-5, minutes=-30))
    rows = history_range(
        later.withColumn(MONTH, month_of("event_timestamp")), datetime(2024, 2, 1, 3, tzinfo=east), datetime(2024, 1, 31, 23, tzinfo=west))
    return rows.select("event_id", "event_timestamp")


@query(f"""
WITH std AS ({STD}) SELECT id AS event_id, type AS event_type FROM std WHERE event_id % 10 <> 0 AND timestamp >= TIMESTAMP '2024-01-16'""")
def history_without_ids(t):
    history = _history(t)
    some = history.withColumn("event_id", F.when(F.col("event_id").cast("long") % 10 != 0, F.col("event_id")))
    return S.new_events(some.unionByName(some), history_range(history, end=datetime(2024, 1, 16))).select("event_id", "event_type")


@query(f"""
WITH std AS ({STD}) SELECT id, '-' AS error_type, CASE WHEN type = '' THEN 'event type is required' WHEN source IS NULL THEN 'event source is required'
  ELSE 'event data is required' END AS error_message,
  CASE WHEN event_id % 3 = 0 THEN 'RESOLVED' WHEN event_id % 3 = 1 THEN 'DEAD' ELSE 'WAITING' END AS state,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 3 ELSE 1 END AS INT) AS retry_count
FROM std WHERE type = '' OR source IS NULL OR data IS NULL""".replace("'-' AS", "'validation_failed' AS"))
def dead_letter_rounds(t):
    # What ingest() rejects goes through three rounds; some outcomes come twice, and some letters are tried once only.
    _, rejected = I.ingest(t.std)
    letters = S.to_dlq(rejected, _now()).drop("original_event_data")
    for round_ in range(3):
        # A round reads its letters twice; unless they are stored, the next one repeats all rounds before it.
        letters = materialise(letters)
        now = F.timestamp_micros(F.unix_micros(_now()) + F.lit(round_ * 86_400_000_000))
        due = D.dlq_due(letters, now).select("original_event_id", F.col("original_event_id").cast("long").alias("n"))
        tried = due.filter((F.col("n") % 3 < 2) | F.lit(round_ == 0))
        lost, both = F.array(F.lit(False)), F.array(F.lit(False), F.lit(True))
        outcomes = tried.select("original_event_id", F.explode(F.when(F.col("n") % 3 == 0, both).otherwise(lost)).alias("succeeded"))
        letters = D.dlq_advance(letters, outcomes, now, 60)
    return letters.select(F.col("original_event_id").alias("id"), "error_type", "error_message", "state", "retry_count")


@query(f"""
WITH std AS ({STD}) SELECT id, CASE WHEN {NOW_SQL} - timestamp <= INTERVAL 7 DAY THEN 'hot'
  WHEN {NOW_SQL} - timestamp <= INTERVAL 90 DAY THEN 'warm' ELSE 'cold' END AS tier FROM std""")
def tier_assignment(t):
    return S.assign_tier(t.std, _now()).select("id", "tier")


@query("""
SELECT CASE WHEN TIMESTAMP '2024-02-01' - ts <= INTERVAL 7 DAY THEN 'hot' WHEN TIMESTAMP '2024-02-01' - ts <= INTERVAL 90 DAY THEN 'warm' ELSE 'cold' END AS tier,
  count(*) AS event_count, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY 1""")
def tier_summary(t):
    return S.tier_summary(t.events, _now(), "ts")


@query("""
SELECT event_id, CAST(event_id % 12 AS INT) AS partition, event_id // 12 AS "offset" FROM events
WHERE event_id // 12 >= 100 AND event_id // 12 < 500""")
def replay_offsets(t):
    topic = t.events.select(
        "event_id", (F.col("event_id") % 12).cast("int").alias("partition"), F.floor(F.col("event_id") / 12).alias("offset")
    )
    return replay(topic, 100, 500)


# Dead letters of the rejected events; some were retried before.
LETTERS = f"""
SELECT id AS original_event_id, tenant_id, {TYPED_ERROR} AS error_type,
  CAST(event_id % 5 AS INT) AS retry_count, CAST(3 AS INT) AS max_retries,
  timestamp + INTERVAL 1 HOUR * (event_id % 48) AS next_retry_at, event_id
FROM std WHERE type = '' OR source IS NULL OR data IS NULL"""


def _letters(t):
    rejected = V.validate_typed(t.std).filter("error IS NOT NULL")
    letters = S.to_dlq(rejected.withColumns({"error_type": F.col("error"), "error_message": F.col("error")}), _now())
    number = F.col("original_event_id").cast("long")
    late = F.timestamp_micros(
        F.unix_micros(F.get_json_object("original_event_data", "$.timestamp").cast("timestamp"))
        + (number % 48) * 3_600_000_000
    )
    return letters.withColumns({"retry_count": (number % 5).cast("int"), "next_retry_at": late})


@query(f"""
WITH std AS ({STD}) SELECT id AS original_event_id, tenant_id, {TYPED_ERROR} AS error_type, {TYPED_ERROR} AS error_message,
  CAST(0 AS INT) AS retry_count, CAST(3 AS INT) AS max_retries, {NOW_SQL} AS next_retry_at, type AS original_type
FROM std WHERE type = '' OR source IS NULL OR data IS NULL""")
def dead_letters(t):
    rejected = V.validate_typed(t.std).filter("error IS NOT NULL")
    letters = S.to_dlq(rejected.withColumns({"error_type": F.col("error"), "error_message": F.col("error")}), _now())
    return letters.select(
        "original_event_id", "tenant_id", "error_type", "error_message", "retry_count", "max_retries", "next_retry_at",
        F.get_json_object("original_event_data", "$.type").alias("original_type"),
    )


@query(f"""
WITH std AS ({STD}), l AS ({LETTERS}) SELECT error_type, tenant_id, retry_count, count(*) AS letter_count,
  count(*) FILTER (retry_count >= max_retries) AS exhausted_count FROM l GROUP BY ALL""")
def dlq_summary(t):
    return D.dlq_summary(_letters(t))


# The retry scan looks from the middle of the month.
MIDDLE = datetime(2024, 1, 16)


@query(f"""
WITH std AS ({STD}), l AS ({LETTERS}) SELECT original_event_id, retry_count FROM l
WHERE retry_count < max_retries AND date_trunc('second', next_retry_at) <= TIMESTAMP '2024-01-16'""")
def dlq_due(t):
    return D.dlq_due(_letters(t), F.lit(MIDDLE).cast("timestamp")).select("original_event_id", "retry_count")


@query(f"""
WITH std AS ({STD}), l AS ({LETTERS}), o AS (SELECT *, retry_count < max_retries AND date_trunc('second', next_retry_at) <= TIMESTAMP '2024-01-16' AS due FROM l),
r AS (SELECT *, due AND event_id % 2 = 0 AS won, due AND event_id % 2 = 1 AS lost FROM o),
n AS (SELECT *, retry_count + lost::INT AS tries FROM r)
SELECT original_event_id, CAST(tries AS INT) AS retry_count,
  CASE WHEN won THEN 'RESOLVED' WHEN tries >= max_retries THEN 'DEAD' ELSE 'WAITING' END AS state,
  CASE WHEN lost AND tries < max_retries THEN TIMESTAMP '2024-01-16' + INTERVAL 1 SECOND * CAST(60 * pow(2, tries) AS INT) END AS retried_at FROM n""")
def dlq_advance(t):
    letters = _letters(t)
    middle = F.lit(MIDDLE).cast("timestamp")
    outcomes = D.dlq_due(letters, middle).select(
        "original_event_id", (F.col("original_event_id").cast("long") % 2 == 0).alias("succeeded")
    )
    after = D.dlq_advance(letters, outcomes, middle, 60)
    retried = F.when((F.col("updated_at") == middle) & (F.col("state") == D.WAITING), F.col("next_retry_at"))
    return after.select("original_event_id", "retry_count", "state", retried.alias("retried_at"))


@query(f"""
WITH std AS ({STD}) SELECT id FROM std WHERE (type = '' OR source IS NULL OR data IS NULL) AND priority <> 3""")
def dlq_missing(t):
    rejected = V.validate_typed(t.std).filter("error IS NOT NULL")
    known = rejected.filter("priority = 3").withColumns({"error_type": F.col("error"), "error_message": F.col("error")})
    return S.dlq_missing(rejected, S.to_dlq(known, _now())).select("id")


MATCHED = "SELECT * FROM std WHERE value > 150 AND type <> ''"


@query(f"""
WITH std AS ({STD}), m AS ({MATCHED}) SELECT id AS original_event_id, tenant_id, 'high_value' AS rule_id, type AS result_type,
  round(value, 2) AS value, timestamp AS event_timestamp FROM m""")
def processed_with_original(t):
    found = t.std.filter("value > 150 AND type <> ''").select("id", "tenant_id", "type", "value")
    processed = S.to_processed(found, F.lit("high_value"), F.col("type"), now=_now())
    joined = S.with_original(processed, _history(t))
    return joined.select(
        "original_event_id", "tenant_id", "rule_id", "result_type",
        F.round(F.get_json_object("result_data", "$.value").cast("double"), 2).alias("value"), "event_timestamp",
    )


@query(f"""
WITH std AS ({STD}), m AS ({MATCHED}), o AS (SELECT id, type, unnest(['elastic', 'hook', 'lake']) AS config_name FROM m)
SELECT id, config_name, CASE config_name WHEN 'elastic' THEN 'ELASTICSEARCH' WHEN 'hook' THEN 'WEBHOOK' ELSE 'PARQUET' END AS sink_type
FROM o WHERE config_name <> 'hook' OR type IN ('purchase', 'error')""")
def routed_results(t):
    outputs = t.spark.createDataFrame(
        [("elastic", "ELASTICSEARCH", '{"index":"events"}', True),
         ("hook", "WEBHOOK", '{"url":"http://host/hook","result_types":["purchase","error"]}', True),
         ("lake", "PARQUET", "{}", True), ("old", "PARQUET", "{}", False)],
        "config_name string, sink_type string, sink_config string, is_active boolean",
    )
    found = t.std.filter("value > 150 AND type <> ''").select("id", "tenant_id", "type", "value")
    routed = S.route(S.to_processed(found, F.lit("high_value"), F.col("type"), now=_now()), outputs)
    return routed.select(
        F.get_json_object("payload", "$.original_event_id").alias("id"), "config_name", "sink_type"
    )
