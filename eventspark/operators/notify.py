"""Notifications as tables: fan-out, rendering, idempotence, delivery status, retries and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.clock import backoff, interval_text
from eventspark.functions.text import render_template
from eventspark.operators.ordered import Running, numbered, prefix, split
from eventspark.operators.sizes import join_lookup

# Delivery states and the steps allowed between them.
PENDING, PROCESSING, SENT, FAILED, DEAD_LETTER = "PENDING", "PROCESSING", "SENT", "FAILED", "DEAD_LETTER"
TRANSITIONS = [
    "PENDING>PROCESSING", "PROCESSING>SENT", "PROCESSING>FAILED", "FAILED>PROCESSING", "FAILED>DEAD_LETTER",
]
# Event categories that may notify.
PROCESSING_EVENTS, ALERT_EVENTS = "processing", "alert"


def should_notify(
    df: DataFrame, category: str = "category", errors: str = "error_count", error_limit: int = 1,
    rule_match: str = "rule_matched",
) -> DataFrame:
    """Events worth a notification, with `immediate`: alerts always and at once, others on a rule match or enough errors."""
    alert = F.col(category) == ALERT_EVENTS
    wanted = alert | F.coalesce(F.col(rule_match), F.lit(False)) | (F.coalesce(F.col(errors), F.lit(0)) >= error_limit)
    return df.filter(wanted).withColumn("immediate", alert)


def _channel(name: str, enabled: str, address: str) -> Column:
    return F.when(
        F.col(enabled), F.struct(F.lit(name).alias("channel"), F.col(address).alias("recipient"))
    )


def fan_out(events: DataFrame, prefs: DataFrame, templates: DataFrame, type_col: str = "type", id_col: str = "id") -> DataFrame:
    """One row per event, subscribed user, enabled channel and active template of that channel.

    Subscriptions meet events in an equi join on the type; adaptive skew handling splits a type that
    is hot on either side.
    """
    channels = F.array_compact(F.array(
        _channel("EMAIL", "email_enabled", "email_address"),
        _channel("SMS", "sms_enabled", "phone_number"),
        _channel("SLACK", "slack_enabled", "slack_user_id"),
    ))
    subscribed = prefs.select(
        "user_id", F.explode(F.array_distinct("subscribed_events")).alias("_type"), channels.alias("_channels")
    ).filter(F.size("_channels") > 0)
    meeting = events.join(subscribed, F.col(type_col) == F.col("_type"), "inner").drop("_type")
    addressed = meeting.select("*", F.inline("_channels")).drop("_channels")
    active = templates.filter("active").select(
        F.col("id").alias("template_id"), F.col("version").alias("template_version"),
        F.col("channel").alias("_template_channel"), F.col("subject").alias("template_subject"), "body_template",
    )
    return join_lookup(addressed, active, F.col("channel") == F.col("_template_channel"), "inner").drop("_template_channel")


def render(df: DataFrame, variables: Column) -> DataFrame:
    """Adds `subject` and `body`: the templates with the variables of each row put in."""
    return df.withColumn("_vars", variables).withColumns(
        {
            "subject": render_template(F.col("template_subject"), F.col("_vars")),
            "body": render_template(F.col("body_template"), F.col("_vars")),
        }
    ).drop("_vars")


def message_id(id_col: str = "id") -> Column:
    """A hash of the message's parts, each after its length, so that no two lists of parts are one text."""
    parts = [F.col(c).cast("string") for c in (id_col, "template_id", "template_version", "recipient", "channel")]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def idempotent(df: DataFrame, log: DataFrame, id_col: str = "id") -> DataFrame:
    """Requests not in the log yet, one per `message_id`."""
    keyed = df.withColumn("message_id", message_id(id_col)).dropDuplicates(["message_id"])
    return keyed.join(log.select(F.col("id").alias("message_id")), "message_id", "left_anti")


def fold_status(log: DataFrame, message: str = "message_id", order: list[str] | None = None) -> DataFrame:
    """Latest status per message, its number of attempts, and how many steps were not allowed.

    A message starts in PENDING; seeing the same status again is no step.
    """
    order = order or ["seq"]
    rows = prefix(split(log, [message], order), {"_from": Running("last", F.col("status"))}, inclusive=False)
    step = F.concat("_from", F.lit(">"), "status")
    begin = F.col("_from").isNull()
    illegal = F.when(begin, F.col("status") != PENDING).otherwise(
        (F.col("_from") != F.col("status")) & ~step.isin(TRANSITIONS)
    )
    point = F.struct(*[F.col(c) for c in order])
    return rows.result().groupBy(message).agg(
        F.max_by("status", point).alias("status"),
        F.count_if(F.col("status") == PROCESSING).alias("attempts"),
        F.count_if(illegal).alias("illegal_steps"),
    )


def plan_retries(log: DataFrame, now: Column, max_retries: int, base_seconds: float) -> DataFrame:
    """Failed messages: when to try again, or DEAD_LETTER once retries are used up."""
    exhausted = F.col("retry_count") >= max_retries
    failed = log.filter(F.col("status") == FAILED)
    return failed.withColumns(
        {
            "next_status": F.when(exhausted, DEAD_LETTER).otherwise(PENDING),
            "scheduled_at": F.when(~exhausted, backoff(now, F.col("retry_count"), base_seconds)),
        }
    )


def delivery_summary(log: DataFrame) -> DataFrame:
    """Per channel: messages by status and the share sent of those finished."""
    def of(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    finished = of(SENT) + of(FAILED) + of(DEAD_LETTER)
    return log.groupBy("channel").agg(
        *[of(s).alias(f"{s.lower()}_count") for s in (PENDING, PROCESSING, SENT, FAILED, DEAD_LETTER)],
        F.when(finished > 0, of(SENT) / finished).alias("success_rate"),
    )


def cap(
    df: DataFrame, n: int, per: str, recipient: list[str], order: list[str], ts: str = "timestamp"
) -> DataFrame:
    """Adds `allowed`: at most `n` messages per recipient and window, the first ones. Nothing is dropped."""
    placed = df.withColumn("_slot", F.window(ts, interval_text(per))["start"])
    counted = numbered(split(placed, [*recipient, "_slot"], order), "_rn").result()
    return counted.withColumn("allowed", F.col("_rn") <= n).drop("_slot", "_rn")


def bulk(df: DataFrame, size: int, keys: list[str], order: list[str], message: str = "message_id") -> DataFrame:
    """Messages of a channel in groups of at most `size`, in order."""
    counted = numbered(split(df, keys, order), "_rn").result()
    chunk = F.floor((F.col("_rn") - 1) / size).cast("long")
    item = F.struct(F.col("_rn").alias("place"), F.col(message).alias("message"))
    # A chunk holds at most `size` messages.
    grouped = counted.withColumn("bulk_index", chunk).groupBy(*keys, "bulk_index").agg(
        F.count(F.lit(1)).alias("message_count"), F.sort_array(F.collect_list(item)).alias("_items")
    )
    return grouped.withColumn("messages", F.transform("_items", lambda i: i["message"])).drop("_items")
