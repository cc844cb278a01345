"""Request metrics, counters, alerts and lag."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventspark.functions.clock import interval_text, micros, parse_duration
from eventspark.functions.text import blank_to_null
from eventspark.operators.ordered import Running, halo, prefix, split, trailing, without_halo
from eventspark.operators.sizes import join_lookup

# Default latency bucket limits in seconds.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
INFINITY = float("inf")
# Alert grouping times.
GROUP_WAIT, GROUP_INTERVAL, REPEAT_INTERVAL = "10s", "10s", "1h"
INHIBIT_LABELS = ["alertname", "dev", "instance"]
# Days from 2024-01-01 to the end of the year 9999, the largest time.
LAST_DAY = 2_913_173


def endpoint_of(route: str = "endpoint", path: str = "path") -> Column:
    """The route pattern, or the raw path where no route matched."""
    return F.coalesce(blank_to_null(F.col(route)), F.col(path))


def http_requests_total(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint", F.col("status").cast("string").alias("status")).agg(
        F.count(F.lit(1)).alias("total")
    )


def http_request_duration(requests: DataFrame, duration: str = "duration_seconds", buckets: list[float] = BUCKETS) -> DataFrame:
    """Cumulative latency buckets per method and endpoint, long form, with sum and count."""
    limits = [*buckets, INFINITY]
    counts = [F.count_if(F.col(duration) <= F.lit(le)).alias(f"_b{i}") for i, le in enumerate(limits)]
    totals = requests.groupBy("method", "endpoint").agg(
        *counts, F.sum(F.col(duration).cast("decimal(38,9)")).alias("_sum"), F.count(duration).alias("_count")
    )
    series = F.array(*[
        F.struct(F.lit(le).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, le in enumerate(limits)
    ])
    return totals.select(
        "method", "endpoint", F.col("_sum").cast("double").alias("duration_sum"),
        F.col("_count").alias("duration_count"), F.inline(series),
    )


def histogram_quantile(buckets: DataFrame, q: float, series: list[str], le: str = "le", cumulative: str = "cumulative") -> DataFrame:
    """Quantile per series by linear interpolation inside the bucket that holds the rank.

    The first bucket starts at 0; a rank in the open last bucket gives the highest finite limit.
    A series has one row per bucket limit.
    """
    along = Window.partitionBy(*series).orderBy(le)
    rows = buckets.select(
        *series, F.col(le).alias("_le"), F.col(cumulative).alias("_cum"),
        F.coalesce(F.lag(le).over(along), F.lit(0.0)).alias("_lower"),
        F.coalesce(F.lag(cumulative).over(along), F.lit(0)).alias("_below"),
        (F.max(cumulative).over(Window.partitionBy(*series)) * F.lit(float(q))).alias("_rank"),
    )
    inside = F.col("_lower") + (F.col("_le") - F.col("_lower")) * (F.col("_rank") - F.col("_below")) / (
        F.col("_cum") - F.col("_below")
    )
    value = F.when(F.col("_le") == INFINITY, F.col("_lower")).when(F.col("_cum") > F.col("_below"), inside)
    hit = rows.filter((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") > 0)).withColumn("_value", value)
    return hit.groupBy(*series).agg(F.min_by("_value", "_le").alias("quantile_value"))


def active_connections(requests: DataFrame, ts: str = "ts", duration: str = "duration_seconds") -> DataFrame:
    """Requests in flight after every change, over all requests.

    Starts and ends at the same instant are netted first; the running sum goes block by block.
    """
    begin = F.unix_micros(ts)
    finish = begin + F.round(F.col(duration) * 1_000_000).cast("long")
    moves = requests.select(F.inline(F.array(
        F.struct(begin.alias("_at"), F.lit(1).cast("long").alias("_delta")),
        F.struct(finish.alias("_at"), F.lit(-1).cast("long").alias("_delta")),
    )))
    changes = moves.groupBy("_at").agg(F.sum("_delta").alias("_delta"))
    summed = prefix(split(changes, [], ["_at"]), {"active": Running("sum", F.col("_delta"))}).result()
    return summed.select(F.timestamp_micros("_at").alias("ts"), "active")


def events_ingested_total(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy(F.col("type").alias("event_type"), "source").agg(F.count(F.lit(1)).alias("total"))


def events_failed_total(rejected: DataFrame, reason: str = "error") -> DataFrame:
    return rejected.groupBy(F.col("type").alias("event_type"), "source", F.col(reason).alias("reason")).agg(
        F.count(F.lit(1)).alias("total")
    )


def rate(samples: DataFrame, window: str, series: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds `rate`: counter increase per second over the trailing window; a fall counts as a restart from 0.

    No extrapolation to the window's edges. Samples of a series have distinct times.
    """
    rows = prefix(split(samples, series, [ts]), {"_before": Running("last", F.col(value))}, inclusive=False).result()
    step = F.when(F.col("_before").isNull(), F.lit(0)).when(
        F.col(value) < F.col("_before"), F.col(value)
    ).otherwise(F.col(value) - F.col("_before"))
    rows = rows.withColumn("_step", step.cast("decimal(28,9)"))
    summed = trailing(rows, series, ts, micros(window), {"_increase": F.col("_step")})
    return summed.withColumn("rate", F.col("_increase").cast("double") / parse_duration(window)).drop(
        "_before", "_step", "_increase"
    )


def error_rate(requests: DataFrame, window: str = "5m", status: str = "^5..$", ts: str = "ts") -> DataFrame:
    """Per window: requests, those whose status matches, per second and as a share."""
    matching = F.col("status").cast("string").rlike(status)
    grouped = requests.groupBy(F.window(ts, interval_text(window))).agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(matching).alias("error_count")
    )
    return grouped.select(
        F.col("window.start").alias("window_start"), "request_count", "error_count",
        (F.col("error_count") / parse_duration(window)).alias("errors_per_second"),
        (F.col("error_count") / F.col("request_count")).alias("error_share"),
    )


def status_classes(requests: DataFrame) -> DataFrame:
    """Requests per endpoint and hundred of the status."""
    return requests.groupBy("endpoint", F.floor(F.col("status") / 100).cast("int").alias("status_class")).agg(
        F.count(F.lit(1)).alias("total")
    )


def alert_for(df: DataFrame, keys: list[str], condition: Column, lasting: str, ts: str = "ts", every: str | None = None) -> DataFrame:
    """Stretches in which every sample of the key meets the condition, for at least `lasting` from first to last.

    One row per stretch: `started_at`, `ended_at`, `sample_count`, and `fired_at`. Samples come `every` so often: a
    longer gap is a sample that doesn't meet the condition.
    """
    marked = df.select(*keys, ts, F.coalesce(condition, F.lit(False)).alias("_on"))
    before = {"_was": Running("last", F.struct(F.col("_on").alias("on"), F.col(ts).alias("at")))}
    rows = prefix(split(marked, keys, [ts]), before, inclusive=False)
    was = F.coalesce(F.col("_was.on"), F.lit(False))
    if every is not None:
        was = was & (F.unix_micros(ts) - F.unix_micros("_was.at") <= micros(every))
    begins = F.col("_on") & ~was
    rows = prefix(rows, {"started_at": Running("last", F.when(begins, F.col(ts)))})
    stretches = rows.result().filter("_on").groupBy(*keys, "started_at").agg(
        F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("sample_count")
    )
    held = F.unix_micros("ended_at") - F.unix_micros("started_at")
    fired = F.timestamp_micros(F.unix_micros("started_at") + micros(lasting))
    return stretches.filter(held >= micros(lasting)).withColumn("fired_at", fired)


def _trailing_windows(requests: DataFrame, window: str, slide: str, series: list[str], aggs: list[Column], ts: str) -> DataFrame:
    """Sums of counts per series at every multiple of `slide`, over the `window` before it: `at`, the series, the counts.

    Rows are counted once per slide, which then goes into the windows it lies in; a slide before no request is no row.
    """
    panes = requests.groupBy(F.window(ts, interval_text(slide)).start.alias("_pane"), *series).agg(*aggs)
    names = [c for c in panes.columns if c not in ("_pane", *series)]
    found = panes.groupBy(F.window("_pane", interval_text(window), interval_text(slide)).end.alias("at"), *series)
    return found.agg(*[F.sum(n).alias(n) for n in names])


def high_error_rate(
    requests: DataFrame, window: str = "5m", threshold: float = 0.1, lasting: str = "5m", slide: str = "15s", status: str = "^5..$", ts: str = "ts",
) -> DataFrame:
    """HighErrorRate: per method, endpoint and status that matches, more than `threshold` requests per second for `lasting`.

    The rate at a time, every `slide`, is the count of the window before it by the window's length.
    """
    series = ["method", "endpoint", "status"]
    matching = requests.withColumn("status", F.col("status").cast("string")).filter(F.col("status").rlike(status))
    counted = _trailing_windows(matching, window, slide, series, [F.count(F.lit(1)).alias("n")], ts)
    high = F.col("n") / parse_duration(window) > threshold
    return _fired(alert_for(counted, series, high, lasting, "at", slide), "HighErrorRate")


def latency_quantiles(
    requests: DataFrame, window: str = "5m", q: float = 0.99, slide: str = "15s", duration: str = "duration_seconds", buckets: list[float] = BUCKETS, ts: str = "ts",
) -> DataFrame:
    """(method, endpoint, at, quantile_value): the latency quantile of the window before each multiple of `slide`, by buckets."""
    series, limits = ["method", "endpoint"], [*buckets, INFINITY]
    counts = [F.count_if(F.col(duration) <= F.lit(le)).alias(f"_b{i}") for i, le in enumerate(limits)]
    sums = _trailing_windows(requests, window, slide, series, counts, ts)
    long = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, le in enumerate(limits)])
    return histogram_quantile(sums.select(*series, "at", F.inline(long)), q, [*series, "at"])


def high_latency(
    requests: DataFrame, window: str = "5m", q: float = 0.99, threshold: float = 0.1, lasting: str = "5m", slide: str = "15s", duration: str = "duration_seconds", ts: str = "ts",
) -> DataFrame:
    """HighLatency: per method and endpoint, a latency quantile above `threshold` seconds for `lasting`."""
    found = latency_quantiles(requests, window, q, slide, duration, ts=ts)
    return _fired(alert_for(found, ["method", "endpoint"], F.col("quantile_value") > threshold, lasting, "at", slide), "HighLatency")


def _fired(stretches: DataFrame, name: str) -> DataFrame:
    return stretches.select(F.lit(name).alias("alertname"), F.lit("warning").alias("severity"), "*")


def inhibit_while(alerts: DataFrame, until: str, ts: str = "ts") -> DataFrame:
    """Drop a warning raised while a critical alert with the same alert name, device and instance is firing.

    An alert fires from `ts` to before `until`; null: still. One pass in time order per set of labels, in which starts
    of critical alerts count up and their ends down; a start counts before a warning of the same instant, an end too.
    """
    labels = [F.coalesce(label, F.lit("")).alias(f"_l_{label}") for label in INHIBIT_LABELS]
    keys = [f"_l_{label}" for label in INHIBIT_LABELS]
    row = F.struct(*[F.col(c) for c in alerts.columns])
    firing = alerts.filter((F.col("severity") == "critical") & (F.col(until).isNull() | (F.col(until) > F.col(ts))))
    moves = firing.select(*labels, F.explode(F.array(F.struct(F.col(ts).alias("at"), F.lit(1).alias("d")), F.struct(F.col(until).alias("at"), F.lit(-1).alias("d")))).alias("m"))
    moves = moves.filter("m.at IS NOT NULL").groupBy(*keys, F.col("m.at").alias("_at")).agg(F.sum("m.d").alias("_d"))
    moves = moves.select("*", F.lit(0).alias("_rank"), F.lit(None).cast(alerts.schema).alias("_row"))
    others = alerts.select(*labels, F.col(ts).alias("_at"), F.lit(0).cast("long").alias("_d"), F.lit(1).alias("_rank"), row.alias("_row"))
    open_ = prefix(split(moves.unionByName(others), keys, ["_at", "_rank"]), {"_open": Running("sum", F.col("_d"))}).result()
    kept = open_.filter((F.col("_rank") == 1) & ~((F.col("_row.severity") == "warning") & (F.col("_open") > 0)).eqNullSafe(F.lit(True)))
    return kept.select("_row.*")


def inhibit(alerts: DataFrame) -> DataFrame:
    """Drop a warning while a critical alert has the same alert name, device and instance (missing equals empty)."""
    def labels(prefix_: str = "") -> list[Column]:
        return [F.coalesce(label, F.lit("")).alias(f"{prefix_}{label}") for label in INHIBIT_LABELS]

    critical = alerts.filter(F.col("severity") == "critical").select(*labels("_c_")).distinct()
    same = F.col("severity") == "warning"
    for label in INHIBIT_LABELS:
        same = same & (F.coalesce(label, F.lit("")) == F.col(f"_c_{label}"))
    return alerts.join(critical, same, "left_anti")


def _notify_ticks(repeat_ticks: int):
    """Per group, over its flush times in order: when a notification goes out and why."""
    def scan(ticks: pd.DataFrame) -> pd.DataFrame:
        ticks = ticks.sort_values("tick")
        last, reasons = None, []
        for tick, fresh in zip(ticks["tick"], ticks["fresh_alerts"]):
            reason = "new" if fresh else "repeat" if last is None or tick - last >= repeat_ticks else None
            if reason:
                last = tick
            reasons.append(reason)
        return ticks.assign(reason=reasons).dropna(subset=["reason"])

    return scan


def group_alerts(
    alerts: DataFrame, wait: str = GROUP_WAIT, interval: str = GROUP_INTERVAL, repeat: str = REPEAT_INTERVAL,
    group: str = "alertname", labels: tuple[str, ...] = ("severity", "dev", "instance"), ts: str = "ts",
) -> DataFrame:
    """Notifications per group: the first after `wait`, then every `interval` if an alert is new, and a
    repetition of known alerts once `repeat` has passed since the last notification.

    Alerts are reduced to one row per group and flush time before groups are walked in order. A missing group is
    the empty text.
    """
    alerts = alerts.withColumn(group, F.coalesce(group, F.lit("")))
    at = F.unix_micros(ts)
    begun = alerts.groupBy(group).agg(F.min(at).alias("_begun"))
    delay, step = micros(wait), micros(interval)
    # Group starts: one row per alert name, broadcast while those are few.
    timed = join_lookup(alerts, begun, group, "inner")
    tick = F.greatest(F.ceil((at - F.col("_begun") - delay) / F.lit(step)), F.lit(0)).cast("long")
    seen = timed.withColumn("tick", tick).groupBy(group, "_begun", *labels, "tick").agg(F.count(F.lit(1)).alias("_n"))
    first = timed.withColumn("tick", tick).groupBy(group, *labels).agg(F.min("tick").alias("_first"))
    same = seen[group].eqNullSafe(first[group])
    for label in labels:
        same = same & seen[label].eqNullSafe(first[label])
    fresh = seen.join(first, same).select(seen[group], "_begun", "tick", "_n", (F.col("_first") == F.col("tick")).alias("_new"))
    ticks = fresh.groupBy(group, "_begun", "tick").agg(
        F.count_if("_new").alias("fresh_alerts"), F.sum("_n").alias("alert_count")
    )
    group_type = ticks.schema[group].dataType.simpleString()
    shape = f"{group} {group_type}, _begun long, tick long, fresh_alerts long, alert_count long, reason string"
    sent = ticks.groupBy(group).applyInPandas(_notify_ticks(micros(repeat) // step), shape)
    return sent.select(
        group, F.timestamp_micros(F.col("_begun") + delay + F.col("tick") * step).alias("notified_at"),
        "fresh_alerts", "alert_count", "reason",
    )


def trend_alert(
    samples: DataFrame, keys: list[str], n: int, limit: float, order: list[str], ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Adds `slope_per_day` over a row and the `n` before it, and `breach_at` where a rising line meets `limit`.

    A breach after the year 9999 has no time.
    """
    rows = halo(split(samples, keys, order), before=n)
    frame = rows.window().rowsBetween(-n, 0)
    # Days since 2024, so that the fit does not lose digits.
    day = (F.unix_micros(ts) - F.lit(1_704_067_200_000_000)) / F.lit(86_400_000_000.0)
    fitted = rows.df.withColumn("_day", day).withColumns(
        {
            "slope_per_day": F.regr_slope(value, "_day").over(frame),
            "_at_zero": F.regr_intercept(value, "_day").over(frame),
        }
    )
    meets = (F.lit(float(limit)) - F.col("_at_zero")) / F.col("slope_per_day")
    ahead = (F.col("slope_per_day") > 0) & (meets >= F.col("_day")) & (meets < LAST_DAY)
    breach = F.when(
        ahead, F.timestamp_micros((F.round(meets * 86_400) * 1_000_000).cast("long") + 1_704_067_200_000_000)
    )
    return without_halo(fitted.withColumn("breach_at", breach).drop("_day", "_at_zero"))


def consumer_lag(ends: DataFrame, committed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lag per partition from `end_offset` and `committed_offset`, never below 0; nothing committed means all."""
    keys = keys or ["partition"]
    joined = ends.join(committed, keys, "left")
    lag = F.greatest(F.col("end_offset") - F.coalesce("committed_offset", F.lit(0)), F.lit(0))
    return joined.withColumn("lag", lag)


def total_lag(lags: DataFrame) -> DataFrame:
    return lags.agg(F.sum("lag").alias("total_lag"), F.max("lag").alias("max_lag"))


def progress_lag(progress: dict) -> list[tuple[str, str, int]]:
    """(topic, partition, lag) from a streaming query's last progress, for topic sources."""
    rows = []
    for source in progress.get("sources", []):
        ends, latest = (
            json.loads(v) if isinstance(v, str) else v for v in (source.get("endOffset"), source.get("latestOffset"))
        )
        for topic, parts in (latest or {}).items():
            for part, end in parts.items():
                rows.append((topic, part, max(end - (ends or {}).get(topic, {}).get(part, 0), 0)))
    return rows

