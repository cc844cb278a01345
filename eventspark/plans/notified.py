"""Queries: notifications. Customers are the users; every customer follows their own orders."""

from pyspark.sql import functions as F

from eventspark.operators import notify as N
from eventspark.plans.catalog import query
from eventspark.plans.tables import NOW

ORDERS = """
SELECT o_orderkey AS id, concat('order.', CAST(o_custkey AS STRING)) AS type, o_totalprice AS amount, o_orderdate AS timestamp, o_orderpriority AS priority FROM orders
"""

# Who has which channel: mail for most, text messages for some.
FANNED = f"""
WITH o AS ({ORDERS}), u AS (SELECT concat('order.', c_custkey) AS t, c_name, c_custkey % 5 <> 0 AS email, c_custkey % 3 = 0 AS sms FROM customer),
f AS (SELECT o.*, c_name, 'EMAIL' AS channel, concat(c_name, '@mail') AS recipient, 'mail' AS template_id FROM o JOIN u ON type = t WHERE email
  UNION ALL SELECT o.*, c_name, 'SMS', concat('+', c_name), 'text' FROM o JOIN u ON type = t WHERE sms)
"""


def _templates(t):
    return t.spark.createDataFrame(
        [("mail", "Order ${id}", "Dear ${name}, order ${id} over ${amount} is in. ${missing}", "EMAIL", 1, True),
         ("text", "", "Order ${id}: ${amount}", "SMS", 3, True), ("old", "", "no", "SMS", 2, False), ("chat", "", "no", "SLACK", 1, True)],
        "id string, subject string, body_template string, channel string, version int, active boolean",
    )


def _fanned(t):
    key = F.col("c_custkey")
    prefs = t.table("customer").select(
        key.alias("user_id"), (key % 5 != 0).alias("email_enabled"), (key % 3 == 0).alias("sms_enabled"),
        F.lit(False).alias("slack_enabled"), F.concat("c_name", F.lit("@mail")).alias("email_address"),
        F.concat(F.lit("+"), "c_name").alias("phone_number"), F.lit(None).cast("string").alias("slack_user_id"),
        F.array(F.concat(F.lit("order."), key.cast("string")), F.lit("news")).alias("subscribed_events"), "c_name",
    )
    names = prefs.select("user_id", "c_name")
    return N.fan_out(t.view(ORDERS), prefs.drop("c_name"), _templates(t)).join(names, "user_id")


@query(FANNED + "SELECT id, channel, recipient, template_id FROM f")
def notify_fanout(t):
    return _fanned(t).select("id", "channel", "recipient", "template_id")


@query(FANNED + """
SELECT id, channel, CASE channel WHEN 'EMAIL' THEN concat('Order ', id) ELSE '' END AS subject,
  CASE channel WHEN 'EMAIL' THEN concat('Dear ', c_name, ', order ', id, ' over ', CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR), ' is in. ${missing}')
    ELSE concat('Order ', id, ': ', CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)) END AS body FROM f""")
def notify_render(t):
    variables = F.create_map(
        F.lit("id"), F.col("id").cast("string"), F.lit("name"), F.col("c_name"),
        F.lit("amount"), F.col("amount").cast("decimal(18,2)").cast("string"),
    )
    return N.render(_fanned(t), variables).select("id", "channel", "subject", "body")


@query(FANNED + """
SELECT id, channel, recipient FROM f WHERE timestamp >= TIMESTAMP '1996-01-01'""")
def notify_idempotent(t):
    # Requests of the early orders are logged already, and everything is asked for twice.
    wanted = _fanned(t).select("id", "channel", "recipient", "template_id", "template_version", "timestamp")
    log = wanted.filter("timestamp < TIMESTAMP '1996-01-01'").select(N.message_id().alias("id"))
    return N.idempotent(wanted.unionByName(wanted), log).select("id", "channel", "recipient")


# Each order's message passes through states by its line items, in line order.
STATES = """
SELECT l_orderkey AS message_id, l_linenumber AS seq, l_partkey AS p, l_suppkey AS q, l_extendedprice AS r, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 50 = 0 THEN 'PROCESSING' ELSE 'PENDING' END
  WHEN l_linenumber IN (2, 4) THEN 'PROCESSING' WHEN l_linenumber = 3 THEN CASE WHEN l_quantity > 25 THEN 'SENT' ELSE 'FAILED' END
  WHEN l_linenumber = 5 THEN 'FAILED' ELSE 'DEAD_LETTER' END AS status FROM lineitem
"""
ALLOWED = ", ".join(f"'{step}'" for step in N.TRANSITIONS)


def _states(t):
    text = STATES.replace("FROM lineitem", f"FROM parquet.`{t.sf_dir}/lineitem.parquet`")
    return t.spark.sql(text)


@query(f"""
WITH s AS ({STATES}), p AS (SELECT *, lag(status) OVER (PARTITION BY message_id ORDER BY seq, p, q, r) AS b FROM s)
SELECT message_id, arg_max(status, (seq, p, q, r)) AS status, count(*) FILTER (status = 'PROCESSING') AS attempts,
  count(*) FILTER (CASE WHEN b IS NULL THEN status <> 'PENDING' ELSE b <> status AND concat(b, '>', status) NOT IN ({ALLOWED}) END) AS illegal_steps
FROM p GROUP BY message_id""")
def notify_status(t):
    return N.fold_status(_states(t), order=["seq", "p", "q", "r"])


LOG = """
SELECT o_orderkey AS message_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SENT' ELSE 'PENDING' END AS status,
  CASE WHEN o_custkey % 3 = 0 THEN 'SMS' ELSE 'EMAIL' END AS channel, CAST(o_orderkey % 6 AS INT) AS retry_count FROM orders
"""


@query(f"""
WITH l AS ({LOG}) SELECT message_id, CASE WHEN retry_count >= 4 THEN 'DEAD_LETTER' ELSE 'PENDING' END AS next_status,
  CASE WHEN retry_count < 4 THEN TIMESTAMP '2024-02-01' + INTERVAL 1 SECOND * CAST(30 * pow(2, retry_count) AS INT) END AS scheduled_at
FROM l WHERE status = 'FAILED'""")
def notify_retry(t):
    planned = N.plan_retries(t.view(LOG), F.lit(NOW).cast("timestamp"), 4, 30)
    return planned.select("message_id", "next_status", "scheduled_at")


@query(f"""
WITH l AS ({LOG}) SELECT channel, count(*) FILTER (status = 'PENDING') AS pending_count, count(*) FILTER (status = 'PROCESSING') AS processing_count,
  count(*) FILTER (status = 'SENT') AS sent_count, count(*) FILTER (status = 'FAILED') AS failed_count,
  count(*) FILTER (status = 'DEAD_LETTER') AS dead_letter_count,
  round(count(*) FILTER (status = 'SENT') / count(*) FILTER (status IN ('SENT', 'FAILED', 'DEAD_LETTER')), 6) AS success_rate FROM l GROUP BY channel""")
def delivery_summary(t):
    return N.delivery_summary(t.view(LOG)).withColumn("success_rate", F.round("success_rate", 6))


@query(FANNED + """
SELECT id, channel, row_number() OVER (PARTITION BY recipient, date_trunc('day', timestamp) ORDER BY timestamp, id) <= 1 AS allowed FROM f""")
def notify_cap(t):
    capped = N.cap(_fanned(t), 1, "1d", ["recipient"], ["timestamp", "id"])
    return capped.select("id", "channel", "allowed")


@query(FANNED + """,
n AS (SELECT channel, id, (row_number() OVER (PARTITION BY channel ORDER BY timestamp, id) - 1) // 50 AS bulk_index, row_number() OVER (PARTITION BY channel ORDER BY timestamp, id) AS place FROM f)
SELECT channel, bulk_index, count(*) AS message_count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS messages FROM n GROUP BY channel, bulk_index""")
def notify_bulk(t):
    groups = N.bulk(_fanned(t), 50, ["channel"], ["timestamp", "id"], message="id")
    return groups.withColumn("messages", F.array_join(F.transform("messages", lambda m: m.cast("string")), ","))


@query("""
SELECT event_id, event_type = 'error' AS immediate FROM events WHERE event_type = 'error' OR value > 100 OR event_id % 40 >= 35""")
def should_notify(t):
    judged = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", N.ALERT_EVENTS).otherwise(N.PROCESSING_EVENTS).alias("category"),
        (F.col("event_id") % 40).alias("error_count"), (F.col("value") > 100).alias("rule_matched"),
    )
    return N.should_notify(judged, error_limit=35).select("event_id", "immediate")
