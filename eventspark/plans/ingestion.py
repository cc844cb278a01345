"""Queries: decoding, validation, ingestion and records."""

from pyspark.sql import functions as F

from eventspark.operators import ingest as I
from eventspark.operators import records as R
from eventspark.operators import validate as V
from eventspark.plans.catalog import query
from eventspark.plans.tables import STD
from eventspark.sources import decode_requests, demux_frames, explode_batch, from_typed_events

# Request bodies of several kinds, good and bad, one per event.
BODIES = """
SELECT event_id, CASE event_id % 8
  WHEN 0 THEN concat('{"type":', CAST(event_id AS STRING), ',"source":"s","data":{}}')
  WHEN 1 THEN concat('type=', event_type)
  WHEN 2 THEN concat('{"type":"', event_type, '","data":', props, '}')
  WHEN 3 THEN concat('{"type":"', event_type, '","source":"s","data":[1]}')
  WHEN 4 THEN concat('{"type":"', event_type, '","source":"s","data":null,"metadata":{"a":"b"}}')
  WHEN 5 THEN concat('{"type":"', event_type, '","source":"s","data":', props, ',"metadata":{"a":1}}')
  ELSE concat('{"type":"', event_type, '","source":"s-', CAST(user_id AS STRING), '","extra":true,"data":', props, '}')
  END AS body FROM events
"""

DECODED = f"""
WITH b AS ({BODIES}), k AS (
  SELECT event_id, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body END AS j FROM b),
t AS (SELECT event_id, ok, j, json_type(j, '$.type') AS tt, json_type(j, '$.source') AS st, json_type(j, '$.data') AS dt,
  json_type(j, '$.metadata.a') AS mt FROM k),
d AS (SELECT *, NOT ok OR coalesce(tt NOT IN ('VARCHAR', 'NULL'), false) OR coalesce(st NOT IN ('VARCHAR', 'NULL'), false)
  OR coalesce(dt NOT IN ('OBJECT', 'NULL'), false) OR coalesce(mt <> 'VARCHAR', false) AS bad FROM t)
"""


@query(DECODED + """
SELECT event_id, CASE WHEN bad THEN 'invalid_json' END AS decode_error,
  CASE WHEN NOT bad THEN j ->> '$.type' END AS type, CASE WHEN NOT bad THEN j ->> '$.source' END AS source,
  CASE WHEN NOT bad AND dt = 'OBJECT' THEN CAST(j ->> '$.data.k' AS BIGINT) END AS k,
  CASE WHEN NOT bad THEN j ->> '$.metadata.a' END AS label FROM d""")
def request_decode(t):
    decoded = decode_requests(t.view(BODIES), "body")
    return decoded.select(
        "event_id", "decode_error", "type", "source",
        F.try_variant_get(F.try_parse_json("data"), "$.k", "long").alias("k"),
        F.try_element_at("metadata", F.lit("a")).alias("label"),
    )


# Envelopes of up to seven requests; every fifth has an item of the wrong kind, some are empty or null.
ENVELOPE = """
CASE WHEN batch_id % 11 = 0 THEN '{"events":[]}' WHEN batch_id % 13 = 0 THEN '{"events":null}'
  WHEN batch_id % 17 = 0 THEN '[1]' ELSE concat('{"events":[', items, ']}') END AS body
"""
ITEM = """
CASE WHEN event_id % 35 = 3 THEN '{"type":7}'
  ELSE concat('{"type":"', event_type, '","source":"s","data":', props, '}') END
"""


@query(f"""
WITH rows AS (SELECT event_id // 7 AS batch_id, event_id % 7 AS idx, event_type, event_id % 35 = 3 AS bad FROM events),
state AS (SELECT batch_id, CASE WHEN batch_id % 11 = 0 OR batch_id % 13 = 0 THEN 'validation_failed'
    WHEN batch_id % 17 = 0 OR bool_or(bad) THEN 'invalid_json' END AS batch_error,
  CASE WHEN batch_id % 11 = 0 THEN 'Field ''Events'' failed validation: min'
    WHEN batch_id % 13 = 0 THEN 'Field ''Events'' failed validation: required' END AS batch_message
  FROM rows GROUP BY batch_id)
SELECT s.batch_id, batch_error, batch_message, CAST(r.idx AS INT) AS idx, r.event_type AS type
FROM state s LEFT JOIN rows r ON r.batch_id = s.batch_id AND s.batch_error IS NULL""")
def batch_explode(t):
    items = t.events.select(
        F.floor(F.col("event_id") / 7).alias("batch_id"), F.struct("event_id", F.expr(ITEM).alias("item")).alias("i")
    )
    # Seven at most.
    batches = items.groupBy("batch_id").agg(F.sort_array(F.collect_list("i")).alias("i")).select(
        "batch_id", F.array_join(F.transform("i", lambda x: x["item"]), ",").alias("items")
    )
    bodies = batches.selectExpr("batch_id", ENVELOPE)
    return explode_batch(bodies, "body").select("batch_id", "batch_error", "batch_message", "idx", "type")


# Envelopes of seven requests, of 101, of none, without a list, cut off, and with an item that lacks its source.
BATCH_BODY = """
CASE batch_id % 6 WHEN 0 THEN '{"events":[]}' WHEN 1 THEN '{}' WHEN 2 THEN concat('{"events":[', items)
  ELSE concat('{"events":[', items, ']}') END AS body
"""
BATCH_ITEM = """
CASE WHEN event_id % 404 = 3 THEN concat('{"type":"', event_type, '","data":', props, '}')
  ELSE concat('{"type":"', event_type, '","source":"s","data":', props, '}') END
"""


@query(f"""
WITH rows AS (SELECT CASE WHEN event_id % 808 < 606 THEN event_id // 7 * 1000 ELSE event_id // 101 * 1000 + 4 END AS b, * FROM events),
given AS (SELECT b, min(b // 1000 + b % 1000) AS batch_id, count(*) AS n, bool_or(event_id % 404 = 3) AS bad FROM rows GROUP BY b)
SELECT b AS batch, CASE WHEN error IS NULL THEN n ELSE 0 END AS processed_count, CASE WHEN error IS NULL THEN 202 ELSE 400 END AS status_code, error
FROM (SELECT *, CASE batch_id % 6 WHEN 0 THEN 'Field ''Events'' failed validation: min' WHEN 1 THEN 'Field ''Events'' failed validation: required'
  WHEN 2 THEN 'invalid_json' ELSE CASE WHEN n > 100 THEN 'Field ''Events'' failed validation: max'
  WHEN bad THEN 'Field ''Source'' failed validation: required' END END AS error FROM given)""")
def http_batch_bodies(t):
    number = F.col("event_id")
    batch = F.when(number % 808 < 606, F.floor(number / 7) * 1000).otherwise(F.floor(number / 101) * 1000 + 4)
    items = t.events.select(batch.alias("b"), F.struct("event_id", F.expr(BATCH_ITEM).alias("item")).alias("i"))
    # 101 at most.
    given = items.groupBy("b").agg(F.sort_array(F.collect_list("i")).alias("i")).select(
        "b", (F.floor(F.col("b") / 1000) + F.col("b") % 1000).alias("batch_id"), F.array_join(F.transform("i", lambda x: x["item"]), ",").alias("items"))
    bodies = given.selectExpr("b AS batch", BATCH_BODY)
    accepted, summary = I.ingest_batch_http(explode_batch(bodies, "body"), "batch", "idx")
    counted = accepted.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    return summary.join(counted, "batch", "left").select("batch", F.coalesce("n", F.lit(0)).alias("processed_count"), "status_code", "error")


@query(f"""
WITH std AS ({STD}) SELECT id, coalesce(data, '{{}}') AS data, timestamp, priority, tenant_id FROM std""")
def typed_convert(t):
    typed = t.std.select("*", F.lit(None).cast("string").alias("schema_version"),
                         F.lit(None).cast("map<string,string>").alias("metadata"))
    return from_typed_events(typed).select("id", "data", "timestamp", "priority", "tenant_id")


@query(f"""
WITH std AS ({STD}), a AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 'ping' WHEN event_id % 6 = 1 THEN 'config' ELSE 'event' END AS arm FROM std),
r AS (SELECT arm, CASE WHEN arm = 'ping' THEN 'pong' WHEN type = '' OR source IS NULL OR data IS NULL THEN 'status' ELSE 'ack' END AS answer,
  CASE WHEN arm = 'event' THEN CASE WHEN type = '' THEN 'event type is required' WHEN source IS NULL THEN 'event source is required'
    WHEN data IS NULL THEN 'event data is required' END END AS message FROM a WHERE arm <> 'config')
SELECT answer, message, count(*) AS n FROM r GROUP BY answer, message""")
def frame_responses(t):
    arm = F.col("event_id") % 6
    frames = t.std.select(
        "event_id",
        F.when(arm > 1, F.struct("id", "type", "source", "tenant_id", "data", "timestamp")).alias("event"),
        F.when(arm == 0, F.struct("timestamp")).alias("ping"),
        F.when(arm == 1, F.struct(F.lit(True).alias("enable_compression"))).alias("config"),
    )
    _, responses = demux_frames(frames)
    answer = F.when(F.col("ack").isNotNull(), "ack").when(F.col("pong").isNotNull(), "pong").otherwise("status")
    return responses.groupBy(answer.alias("answer"), F.col("status.message").alias("message")).agg(
        F.count(F.lit(1)).alias("n")
    )


TYPED_ERROR = """CASE WHEN type = '' THEN 'event type is required' WHEN source IS NULL THEN 'event source is required'
  WHEN data IS NULL THEN 'event data is required' END"""
HTTP_ERROR = """CASE WHEN type = '' THEN 'Field ''Type'' failed validation: required'
  WHEN source IS NULL THEN 'Field ''Source'' failed validation: required'
  WHEN data IS NULL THEN 'Field ''Data'' failed validation: required' END"""


@query(f"WITH std AS ({STD}) SELECT id, {TYPED_ERROR} AS error FROM std")
def validate_typed(t):
    return V.validate_typed(t.std).select("id", "error")


@query(f"WITH std AS ({STD}) SELECT id, {HTTP_ERROR} AS error FROM std")
def validate_http(t):
    return V.validate_http(t.std).select("id", "error")


@query(f"""
WITH std AS ({STD}), e AS (SELECT *, {TYPED_ERROR} AS first FROM std)
SELECT id, first IS NULL AS is_valid,
  CAST((first IS NOT NULL)::INT + (type = '')::INT + (source IS NULL)::INT AS INT) AS error_count,
  concat_ws(';', CASE WHEN first IS NOT NULL THEN concat('event:', first, ':VALIDATION_FAILED') END,
    CASE WHEN type = '' THEN 'type:event type is required:REQUIRED_FIELD' END,
    CASE WHEN source IS NULL THEN 'source:event source is required:REQUIRED_FIELD' END) AS errors FROM e""")
def validation_report(t):
    text = F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["message"], e["code"]))
    return V.validation_report(t.std).select(
        "id", "is_valid", F.size("errors").alias("error_count"), F.array_join(text, ";").alias("errors")
    )


@query(f"""
WITH std AS ({STD}) SELECT event_id, event_id % 3 <> 0 AS kept_id, true AS has_id, event_id % 5 <> 0 AS kept_time,
  true AS has_time FROM std""")
def defaults_filled(t):
    given = t.std.withColumns({
        "given_id": F.when(F.col("event_id") % 3 != 0, F.col("id")).otherwise(""),
        "given_ts": F.when(F.col("event_id") % 5 != 0, F.col("timestamp")),
    }).select("event_id", F.col("given_id").alias("id"), F.col("given_ts").alias("timestamp"), "given_id", "given_ts")
    filled = V.with_defaults(given)
    return filled.select(
        "event_id", (F.col("id") == F.col("given_id")).alias("kept_id"), (F.length("id") > 0).alias("has_id"),
        F.coalesce(F.col("timestamp") == F.col("given_ts"), F.lit(False)).alias("kept_time"),
        F.col("timestamp").isNotNull().alias("has_time"),
    )


@query(f"""
WITH std AS ({STD}) SELECT id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE concat('req-', id) END AS request_id,
  concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS client_ip, 'agent' AS user_agent, CAST(event_id % 7 AS STRING) AS batch_index,
  concat('r-', CAST(user_id % 2 AS STRING)) AS region, CAST(5 AS INT) AS entries FROM std""")
def stamped_metadata(t):
    given = t.std.withColumns({
        "request_id": F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("req-"), "id")),
        "client_ip": F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")),
        "user_agent": F.lit("agent"),
        "idx": F.col("event_id") % 7,
        "metadata": F.create_map(
            F.lit("region"), F.concat(F.lit("r-"), (F.col("user_id") % 2).cast("string")),
            F.lit("client_ip"), F.lit("forged"),
        ),
    })
    stamped = V.stamp_metadata(given, batch_index="idx")
    names = ["request_id", "client_ip", "user_agent", "batch_index", "region"]
    return stamped.select("id", *[F.col("metadata")[n].alias(n) for n in names], F.size("metadata").alias("entries"))


@query(f"""WITH std AS ({STD}) SELECT id, event_id % 4 <> 0 AS kept, true AS is_set FROM std""")
def request_ids(t):
    given = t.std.withColumn("given", F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("req-"), "id")))
    filled = V.with_request_id(given.withColumn("request_id", F.col("given")))
    return filled.select(
        "id", F.coalesce(F.col("request_id") == F.col("given"), F.lit(False)).alias("kept"),
        F.col("request_id").isNotNull().alias("is_set"),
    )


@query("SELECT page_id, strlen(html) > 1024 AS too_large FROM pages")
def size_limit(t):
    return V.limit_size(t.table("pages"), "1KB", "html").select("page_id", "too_large")


@query(f"""
WITH std AS ({STD}), c AS (SELECT CASE WHEN event_id % 29 = 0 THEN 429 WHEN event_id % 31 = 0 THEN 413
  WHEN type = '' OR source IS NULL OR data IS NULL THEN 400 WHEN event_id % 37 = 0 THEN 500 ELSE 202 END AS status_code FROM std)
SELECT CAST(status_code AS INT) AS status_code, count(*) AS n FROM c GROUP BY status_code""")
def outcome_codes(t):
    checked = V.validate_http(t.std).withColumns({
        "rate_limited": F.col("event_id") % 29 == 0, "too_large": F.col("event_id") % 31 == 0,
        "send_failed": F.col("event_id") % 37 == 0,
    })
    return V.classify_outcome(checked).groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


# The topic partition (of 12) of each type in the tables.
PLACES = "(VALUES ('click', 11), ('error', 1), ('purchase', 10), ('signup', 7), ('view', 8)) AS p(key, place)"


@query(f"""
WITH std AS ({STD}) SELECT id, CAST(place AS INT) AS partition,
  row_number() OVER (PARTITION BY place ORDER BY event_id) - 1 AS "offset", 'ACCEPTED' AS status
FROM std JOIN {PLACES} ON type = key WHERE source IS NOT NULL AND data IS NOT NULL""")
def ingest_accepted(t):
    accepted, _ = I.ingest(t.std, arrival=["event_id"])
    return accepted.select("id", "partition", "offset", "status")


@query(f"""
WITH std AS ({STD}) SELECT id, {TYPED_ERROR} AS error_message, 'REJECTED' AS status FROM std
WHERE type = '' OR source IS NULL OR data IS NULL""")
def ingest_rejected(t):
    _, rejected = I.ingest(t.std, arrival=["event_id"])
    return rejected.select("id", "error_message", "status")


BATCHED = f"""
WITH std AS ({STD}), b AS (SELECT *, event_id // 7 AS batch_id, event_id % 7 AS idx, {TYPED_ERROR} AS error,
  {HTTP_ERROR} AS http FROM std)"""


def _batched(t):
    return t.std.withColumns({"batch_id": F.floor(F.col("event_id") / 7), "idx": F.col("event_id") % 7})


@query(BATCHED + """
SELECT batch_id, idx, id, CASE WHEN error IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, error AS error_message FROM b""")
def ingest_batch_partial(t):
    results = I.ingest_batch(_batched(t), "batch_id", "idx")
    return I.batch_results(results, "batch_id", "idx").select("batch_id", "idx", "id", "status", "error_message")


@query(BATCHED + """, f AS (SELECT *, min(CASE WHEN error IS NOT NULL THEN idx END) OVER (PARTITION BY batch_id) AS bad FROM b)
SELECT batch_id, idx, id, CASE WHEN error IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, error AS error_message
FROM f WHERE bad IS NULL OR idx <= bad""")
def ingest_batch_failfast(t):
    results = I.ingest_batch(_batched(t), "batch_id", "idx", fail_fast=True)
    return results.select("batch_id", "idx", "id", "status", "error_message")


@query(BATCHED + """
SELECT batch_id, count(*) FILTER (error IS NULL) AS success_count, count(*) FILTER (error IS NOT NULL) AS failure_count,
  count(*) AS result_count FROM b GROUP BY batch_id""")
def ingest_batch_summary(t):
    return I.batch_summary(I.ingest_batch(_batched(t), "batch_id", "idx"), "batch_id")


@query(BATCHED + """
SELECT batch_id, count(*) AS event_count, CASE WHEN count(http) > 0 THEN 0 ELSE count(*) END AS processed_count,
  CAST(0 AS BIGINT) AS failed_count, CAST(CASE WHEN count(http) > 0 THEN 400 ELSE 202 END AS INT) AS status_code,
  arg_min(http, idx) FILTER (http IS NOT NULL) AS error FROM b GROUP BY batch_id""")
def ingest_batch_http(t):
    _, summary = I.ingest_batch_http(_batched(t), "batch_id", "idx")
    return summary


@query(BATCHED + """
SELECT batch_id, idx, id FROM b QUALIFY count(http) OVER (PARTITION BY batch_id) = 0""")
def ingest_batch_http_events(t):
    accepted, _ = I.ingest_batch_http(_batched(t), "batch_id", "idx")
    return accepted.select("batch_id", "idx", "id")


@query(BATCHED + """
SELECT batch_id, idx, 'accepted' AS status, CAST(idx AS VARCHAR) AS batch_index, TRUE AS has_own_id FROM b QUALIFY count(http) OVER (PARTITION BY batch_id) = 0""")
def http_batch_accepted(t):
    events, results, _ = I.accept_batch_http(_batched(t), "batch_id", "idx")
    stamped = events.select(F.col("id").alias("event_id"), F.col("metadata")["batch_index"].alias("batch_index"), F.col("timestamp").isNotNull().alias("has_time"))
    # Every event's id is told once, by its own result.
    return results.join(stamped, "event_id").select(
        "batch_id", "idx", "status", "batch_index", (F.col("has_time") & (F.length("event_id") > 20)).alias("has_own_id"))


@query(BATCHED + """
SELECT id, max(CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY idx) = 0 AS sent FROM b""")
def send_batch_stop(t):
    failing = _batched(t).withColumn("failed", F.col("event_id") % 37 == 0)
    return I.send_batch(failing, "batch_id", "idx", "failed").select("id", "sent")


@query(f"""
WITH std AS ({STD}) SELECT id AS event_id, type AS event_type, coalesce(source, '') AS source, 'events' AS topic,
  type AS key, timestamp FROM std""")
def record_headers(t):
    header = lambda i: F.decode(F.col("headers")[i]["value"], "UTF-8")
    return R.to_records(t.std).select(
        header(0).alias("event_id"), header(1).alias("event_type"), header(2).alias("source"), "topic", "key", "timestamp"
    )


@query(f"""
WITH std AS ({STD}) SELECT id, type, coalesce(source, '') AS source, tenant_id, CAST(data ->> '$.k' AS BIGINT) AS k,
  concat(regexp_replace(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', ''), 'Z') AS timestamp,
  correlation_id, CASE WHEN priority <> 0 THEN CAST(priority AS BIGINT) END AS priority, priority <> 0 AS has_priority,
  false AS has_subject FROM std""")
def record_values(t):
    value = F.parse_json("value")
    get = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind).alias(name)
    return R.to_records(t.std).withColumn("_v", value).select(
        *[get(n, "string") for n in ("id", "type", "source", "tenant_id", "timestamp", "correlation_id")],
        F.try_variant_get("_v", "$.data.k", "long").alias("k"), get("priority", "long"),
        F.contains("value", F.lit('"priority"')).alias("has_priority"),
        F.contains("value", F.lit('"subject"')).alias("has_subject"),
    )


@query(f"SELECT event_id, event_type AS key, CAST(place AS INT) AS partition FROM events JOIN {PLACES} ON event_type = key")
def record_partition(t):
    keyed = t.events.select("event_id", F.col("event_type").alias("key"))
    return R.with_partition(keyed).select("event_id", "key", "partition")


@query(f"""
SELECT event_id, CAST(place AS INT) AS partition,
  100 + row_number() OVER (PARTITION BY place ORDER BY ts, event_id) - 1 AS "offset" FROM events JOIN {PLACES} ON event_type = key""")
def record_offsets(t):
    placed = R.with_partition(t.events.withColumn("key", F.col("event_type")))
    base = placed.groupBy("partition").agg(F.lit(100).cast("long").alias("base_offset"))
    return R.with_offsets(placed, ["ts", "event_id"], base).select("event_id", "partition", "offset")


@query(f"""
WITH std AS ({STD}) SELECT id, type, CASE WHEN event_id % 2 = 1 THEN tenant_id END AS tenant_id,
  CASE WHEN event_id % 2 = 1 THEN priority END AS priority, CASE WHEN event_id % 2 = 0 THEN 'web' END AS subject FROM std""")
def union_protocols(t):
    even = F.col("event_id") % 2 == 0
    http = t.std.filter(even).select("id", "type", F.lit("web").alias("subject"))
    typed = t.std.filter(~even).select("id", "type", "tenant_id", "priority")
    return I.union_protocols(http, typed).select("id", "type", "tenant_id", "priority", "subject")


@query(f"WITH std AS ({STD}) SELECT id, priority, timestamp FROM std ORDER BY priority DESC, timestamp")
def priority_order(t):
    return I.by_priority(t.std).select("id", "priority", "timestamp")
