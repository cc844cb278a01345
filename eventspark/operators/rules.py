"""Rules stored as data: SQL rules, threshold rules, stages, and backtests.

Loops run over rules (configuration); events are only ever touched by Spark plans.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.functions.clock import interval_text
from eventspark.operators.rule_index import match_index, parsed_rules, total_index
from eventspark.sources.config import load_active

RESULT = "rule_id string, result_type string, original_event_id string, tenant_id string, result_data string"


def latest_version(df: DataFrame, name_col: str, version_col: str) -> DataFrame:
    """The latest active version per name."""
    return load_active(df, name_col, version_col)


@contextmanager
def _literal_text(spark: SparkSession):
    """Rule text is run as written: no `${...}` substitution."""
    key = "spark.sql.variable.substitute"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Views:
    """Named frames for rule texts. Names live in the rule's own query, so the session's views are left alone and two
    callers don't see each other's."""

    def __init__(self, spark: SparkSession, views: dict[str, DataFrame], ts: str | None = None):
        self.spark, self.ts = spark, ts
        self.names: dict[str, str] = {}
        self.columns: dict[str, list[str]] = {}
        for name, frame in views.items():
            self.add(name, frame)

    def add(self, name: str, frame: DataFrame) -> None:
        self.names[name] = f"rule_view_{uuid.uuid4().hex}"
        self.columns[name] = frame.columns
        frame.createOrReplaceTempView(self.names[name])

    def _known(self, filtered: str = "") -> str:
        own = lambda n: ", ".join(f"`{c}`" for c in self.columns[n])
        timed = lambda n: filtered if self.ts in self.columns[n] else ""
        return ", ".join(f"`{n}` AS (SELECT {own(n)} FROM `{u}` AS v {timed(n)})" for n, u in self.names.items())

    def query(self, text: str, window: str | None = None) -> DataFrame:
        """A rule's rows; with a window those of each tumbling window of `ts` by itself, and the window.

        As a subquery only a read can be written; commands do not parse.
        """
        rule = f"SELECT * FROM (\n{text.strip().rstrip(';')}\n) AS rule_result"
        known = self._known()
        if window is None:
            whole = f"WITH {known} {rule}" if known else rule
        else:
            size = interval_text(window)
            of = f"window(`{self.ts}`, '{size}')"
            timed = [u for n, u in self.names.items() if self.ts in self.columns[n]]
            if not timed:
                raise ValueError(f"a rule has a window, but no view has the column {self.ts}")
            every = " UNION ".join(f"SELECT DISTINCT {of} AS w FROM `{u}` WHERE `{self.ts}` IS NOT NULL" for u in timed)
            # Spark makes a lateral query of equal windows a join and a grouping by window.
            inner = self._known(f"WHERE window(v.`{self.ts}`, '{size}').start = every.window_start")
            whole = (f"SELECT every.window_start, every.window_end, r.* FROM (SELECT w.start AS window_start, w.end AS window_end FROM ({every})) AS every, "
                     f"LATERAL (WITH {inner} {rule}) AS r")
        with _literal_text(self.spark):
            return self.spark.sql(whole)

    def __enter__(self) -> _Views:
        return self

    def __exit__(self, *_) -> None:
        # Plans that were made hold what the names stood for.
        for name in self.names.values():
            self.spark.catalog.dropTempView(name)


def _window(rule, ts: str | None) -> str | None:
    return json.loads(rule.rule_config or "{}").get("window") if ts else None


def _result_rows(found: DataFrame, name: str, kind: str, event_id: str, tenant: str) -> DataFrame:
    def optional(column: str) -> Column:
        return F.col(column).cast("string") if column in found.columns else F.lit(None).cast("string")

    return found.select(
        F.lit(name).alias("rule_id"),
        F.lit(kind).alias("result_type"),
        optional(event_id).alias("original_event_id"),
        optional(tenant).alias("tenant_id"),
        F.to_json(F.struct("*")).alias("result_data"),
    )


def _rule_rows(rules: DataFrame) -> list:
    return rules.orderBy("rule_name", "rule_version").collect()


def run_rules(
    spark: SparkSession, rules: DataFrame, views: dict[str, DataFrame], event_id: str = "event_id", tenant: str = "tenant_id", ts: str | None = None,
) -> DataFrame:
    """Run the latest active version of every SQL rule over the named views; one lazy plan.

    With `ts`, a rule whose config has a `window` runs on each tumbling window of that column by itself, and its rows
    have `window_start` and `window_end`.
    """
    with _Views(spark, views, ts) as known:
        parts = [
            _result_rows(known.query(rule.rule_definition, _window(rule, ts)), rule.rule_name, rule.rule_type, event_id, tenant)
            for rule in _rule_rows(latest_version(rules, "rule_name", "rule_version"))
        ]
    if not parts:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, parts)


def rule_outputs(spark: SparkSession, rules: DataFrame, views: dict[str, DataFrame], ts: str) -> dict[str, DataFrame]:
    """The rows of each rule whose config names an `output`, by that name, with the window's columns if it has one.

    Rules of one output are one frame and must have the same columns.
    """
    found: dict[str, DataFrame] = {}
    with _Views(spark, views, ts) as known:
        for rule in _rule_rows(latest_version(rules, "rule_name", "rule_version")):
            output = json.loads(rule.rule_config or "{}").get("output")
            if output:
                rows = known.query(rule.rule_definition, _window(rule, ts))
                found[output] = found[output].unionByName(rows) if output in found else rows
    return found


def upsert_output(rows: DataFrame, path: str, by: str = "window_start") -> None:
    """Write an output's rows; the windows (or other values of `by`) that they have replace those stored before.

    Run again, it changes nothing.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def run_rule_stages(
    spark: SparkSession, rules: DataFrame, views: dict[str, DataFrame], event_id: str = "event_id", tenant: str = "tenant_id"
) -> DataFrame:
    """As `run_rules`, by `rule_config.stage` (default 0); a rule's rows are a view, named as the rule, for later stages."""
    rows = _rule_rows(latest_version(rules, "rule_name", "rule_version"))
    stage = lambda rule: int(json.loads(rule.rule_config or "{}").get("stage", 0))
    parts, waiting, current = [], [], None
    with _Views(spark, views) as known:
        for rule in sorted(rows, key=lambda r: (stage(r), r.rule_name)):
            if current is not None and stage(rule) != current:
                for name, found in waiting:
                    known.add(name, found)
                waiting = []
            current = stage(rule)
            found = known.query(rule.rule_definition)
            waiting.append((rule.rule_name, found))
            parts.append(_result_rows(found, rule.rule_name, rule.rule_type, event_id, tenant))
    if not parts:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, parts)


def match_rules(events: DataFrame, rules: DataFrame, type_col: str = "type", data: str = "data") -> DataFrame:
    """All threshold rules in one pass over the events, by an index (see `rule_index`).

    A rule's config is `{"event_type", "field", "op", "threshold"}`, `op` one of > >= < <= =; the event
    must be of the type and its payload field compare true.
    """
    active = latest_version(rules, "rule_name", "rule_version")
    return match_index(events, parsed_rules(active), type_col, data)


def match_totals(events: DataFrame, rules: DataFrame, by: list[str], type_col: str = "type", data: str = "data") -> DataFrame:
    """What `match_rules` finds, counted by the columns `by`: n_rules, thresholds (their sum) and first_rule.

    No row is made for an event and a rule, so the cost grows with events plus rules.
    """
    active = latest_version(rules, "rule_name", "rule_version")
    return total_index(events, parsed_rules(active), by, type_col, data)


def backtest_rules(
    spark: SparkSession, rules: DataFrame, events: DataFrame, start, end, view: str = "events",
    ts: str = "event_timestamp", tenant: str = "tenant_id",
) -> tuple[DataFrame, DataFrame]:
    """Run active and candidate (inactive) rule versions over `[start, end)` of the history.

    Returns matches per rule, tenant and day with their change from active to candidate, and the
    rules that do not analyse or lack the time or tenant column.
    """
    within = events.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    counts, problems = {True: [], False: []}, []
    newest = rules.groupBy("rule_name", "is_active").agg(F.max_by(F.struct("*"), "rule_version").alias("_r"))
    with _Views(spark, {view: within}) as known:
        for rule in _rule_rows(newest.select("_r.*")):
            try:
                found = known.query(rule.rule_definition)
                by_day = found.groupBy(
                    F.lit(rule.rule_name).alias("rule_id"), F.col(tenant).alias("tenant_id"),
                    F.to_date(ts).alias("day"),
                ).agg(F.count(F.lit(1)).alias("matches"))
            except PySparkException as error:
                problems.append((rule.rule_name, rule.rule_version, str(error).splitlines()[0]))
                continue
            counts[bool(rule.is_active)].append(by_day)
    empty = spark.createDataFrame([], "rule_id string, tenant_id string, day date, matches long")
    keys = ["rule_id", "tenant_id", "day"]
    old = reduce(DataFrame.unionByName, counts[True], empty).withColumnRenamed("matches", "active_matches")
    new = reduce(DataFrame.unionByName, counts[False], empty).withColumnRenamed("matches", "candidate_matches")
    left, right = old.alias("o"), new.alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    active = F.coalesce("active_matches", F.lit(0))
    candidate = F.coalesce("candidate_matches", F.lit(0))
    compared = left.join(right, same, "full").select(
        *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys],
        active.alias("active_matches"), candidate.alias("candidate_matches"),
        (candidate - active).alias("difference"),
    )
    return compared, spark.createDataFrame(problems, "rule_name string, rule_version int, problem string")
