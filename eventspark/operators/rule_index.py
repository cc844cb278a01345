"""Threshold rules as an index over values: an event's cost grows with the rules it meets, not with the rules there are.

Rules of one event type, field and comparison are sorted by threshold and cut into blocks of `BLOCK_RULES`. An event's
payload is parsed once; the value of each field its type is asked for finds its blocks by binary search in the (at most
five) arrays of that field's first thresholds, and the event is joined with the rules of those blocks only.

`total_index` makes no row for an event and rule: counts, sums and first rules are running totals along the distinct
values and thresholds of a type's field, which events look up. Its cost doesn't depend on how many rules events meet.

The fields that rules name are literals of the plan, so they are read on the driver, at most `FIELDS_PER_PASS` a pass
over the events. Rules stay in Spark: the arrays are one row per event type and are joined like any lookup.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.operators.ordered import Running, numbered, prefix, split
from eventspark.operators.sizes import join_lookup
from eventspark.session import materialise

FIELDS_PER_PASS = 256
#: An event is compared with so many rules at each end of its run.
BLOCK_RULES = 512
OPS = (">", ">=", "<", "<=", "=")
_FIELD = re.compile(r"[^.\[\]'\"`]+(\.[^.\[\]'\"`]+|\[\d+\])*")


def parsed_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, event_type, field, op, threshold) of rules whose config is complete; `op` defaults to >."""
    part = lambda path: F.get_json_object("rule_config", path)
    wanted = rules.select(
        F.col("rule_name").alias("rule_id"), part("$.event_type").alias("event_type"), part("$.field").alias("field"),
        F.coalesce(part("$.op"), F.lit(">")).alias("op"), part("$.threshold").try_cast("double").alias("threshold"),
    )
    return wanted.filter(F.col("event_type").isNotNull() & F.col("field").isNotNull() & F.col("threshold").isNotNull() & F.col("op").isin(*OPS))


def in_blocks(parsed: DataFrame) -> DataFrame:
    """The rules with `block`, their place along the thresholds of their type, field and comparison."""
    rows = numbered(split(parsed, ["event_type", "field", "op"], ["threshold", "rule_id"]), "_place")
    return rows.result().withColumn("block", F.floor((F.col("_place") - 1) / BLOCK_RULES).cast("int")).drop("_place")


def build_index(blocks: DataFrame, fields: list[str]) -> DataFrame:
    """One row per event type: `_tests`, an array of (at, op, limits), `at` being the field's place in `fields`.

    `limits` holds the first threshold of each block.
    """
    firsts = blocks.groupBy("event_type", "field", "op", "block").agg(F.min("threshold").alias("threshold"))
    entry = F.struct("block", "threshold")
    runs = firsts.groupBy("event_type", _place_of(fields).alias("at"), "op").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    test = F.struct("at", "op", F.col("e.threshold").alias("limits"))
    return runs.groupBy(F.col("event_type").alias("_event_type")).agg(F.collect_list(test).alias("_tests"))


def _place_of(fields: list[str]) -> Column:
    return F.create_map(*[x for k, name in enumerate(fields) for x in (F.lit(name), F.lit(k))])[F.col("field")]


def _below(limits: Column, value: Column, strict: Column, steps: int) -> Column:
    """How many of the sorted limits are less than the value, or not greater where `strict` is false."""
    n = F.size(limits)
    return F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]), F.lit(0),
        lambda low, jump: F.when(
            (low + jump <= n) & ((F.get(limits, low + jump - 1) < value) | (~strict & (F.get(limits, low + jump - 1) == value))), low + jump,
        ).otherwise(low))


def _visits(test: Column, value: Column, steps: int) -> Column:
    """(at, op, block, value) of the blocks of one array that may hold rules for the value."""
    op, limits = test["op"], test["limits"]
    # A block that begins below the value may go on beyond it.
    under = _below(limits, value, op.isin(">", "<=", "="), steps)
    first = F.when(op.isin("<", "<=", "="), F.greatest(under - 1, F.lit(0))).otherwise(0)
    last = F.when(op.isin(">", ">="), under).when(op == "=", _below(limits, value, F.lit(False), steps)).otherwise(F.size(limits))
    made = F.transform(F.sequence(first, last - 1), lambda k: F.struct(test["at"].alias("at"), op.alias("op"), k.alias("block"), value.alias("value")))
    return F.when(value.isNotNull() & (last > first), made).otherwise(F.array().cast(_VISITS))


_VISITS = "array<struct<at:int,op:string,block:int,value:double>>"
_FOUND = "rule_id string, threshold double, matched_value double"


def _holds(op: Column, value: Column, threshold: Column) -> Column:
    return (
        F.when(op == ">", value > threshold).when(op == ">=", value >= threshold).when(op == "<", value < threshold)
        .when(op == "<=", value <= threshold).otherwise(value == threshold))


def _passes(parsed: DataFrame) -> list[list[tuple[str, list[str]]]]:
    """The fields that are paths, each with the event types it is asked of, in passes over the events."""
    shape = parsed.groupBy("field").agg(F.collect_set("event_type").alias("types"))
    asked = sorted(((r["field"], r["types"]) for r in shape.collect() if _FIELD.fullmatch(r["field"])), key=lambda r: r[0])
    return [asked[at : at + FIELDS_PER_PASS] for at in range(0, len(asked), FIELDS_PER_PASS)]


def _values(fields: list[tuple[str, list[str]]], type_col: str) -> Column:
    """The numbers of a parsed payload `_json` at the fields that the event's type is asked for."""
    return F.array(*[
        F.when(F.col(type_col).isin(types), F.try_variant_get("_json", f"$.{name}", "string").try_cast("double")) for name, types in fields])


def match_index(events: DataFrame, parsed: DataFrame, type_col: str = "type", data: str = "data") -> DataFrame:
    """The events' columns with rule_id, threshold and matched_value, a row per event and rule that holds.

    A value that isn't a number (or text of one) meets no rule, and neither does a payload that isn't JSON. NaN is the
    greatest number. A rule whose field is no path of names and places in arrays meets nothing.
    """
    passes = _passes(parsed)
    if not passes:
        nothing = events.select(*_columns(events), F.explode(F.from_json(F.lit("[]"), f"array<struct<{_FOUND}>>")).alias("_hit"))
        return nothing.select(*_columns(events), "_hit.*")
    blocks = in_blocks(parsed)
    largest = parsed.groupBy("event_type", "field", "op").count().agg(F.max("count")).first()[0]
    steps = int(-(-largest // BLOCK_RULES)).bit_length()
    parts = []
    for fields in passes:
        names = [name for name, _ in fields]
        own = blocks.filter(F.col("field").isin(names))
        rows = join_lookup(events, build_index(own, names), F.col(type_col) == F.col("_event_type"), "inner").withColumn("_json", F.try_parse_json(data))
        visits = F.flatten(F.transform("_tests", lambda t: _visits(t, F.get(F.col("_values"), t["at"]), steps)))
        rows = rows.withColumn("_values", _values(fields, type_col)).withColumn("_visit", F.explode(visits))
        rows = rows.select(*_columns(events), "_event_type", "_visit")
        rules = own.select(*[F.col(c).alias(f"_rule_{c}") for c in ("event_type", "op", "block", "threshold", "rule_id")], _place_of(names).alias("_rule_at"))
        visit = lambda name: F.col(f"_visit.{name}")
        on = (F.col("_event_type") == F.col("_rule_event_type")) & (visit("at") == F.col("_rule_at")) & (visit("op") == F.col("_rule_op"))
        on &= (visit("block") == F.col("_rule_block")) & _holds(F.col("_rule_op"), visit("value"), F.col("_rule_threshold"))
        found = join_lookup(rows, rules, on, "inner")
        parts.append(found.select(
            *_columns(events), F.col("_rule_rule_id").alias("rule_id"), F.col("_rule_threshold").alias("threshold"), visit("value").alias("matched_value")))
    return reduce(DataFrame.union, parts)


def total_index(events: DataFrame, parsed: DataFrame, by: list[str], type_col: str = "type", data: str = "data") -> DataFrame:
    """`by` with n_rules, thresholds (their sum) and first_rule (the least id) over what `match_index` finds."""
    passes = _passes(parsed)
    if not passes:
        return _totals(match_index(events, parsed, type_col, data).select(
            *by, F.lit(1).cast("long").alias("n_rules"), F.col("threshold").alias("thresholds"), F.col("rule_id").alias("first_rule")), by)
    parts = []
    for fields in passes:
        rows = events.withColumn("_json", F.try_parse_json(data)).withColumn("_values", _values(fields, type_col))
        named = F.arrays_zip(F.array(*[F.lit(name) for name, _ in fields]).alias("field"), F.col("_values").alias("value"))
        asked = F.filter(named, lambda x: x["value"].isNotNull())
        parts.append(rows.select(*by, F.col(type_col).alias("_type"), F.explode(asked).alias("_x")).select(
            *by, "_type", F.col("_x.field").alias("_field"), F.col("_x.value").alias("_value")))
    values, point = reduce(DataFrame.union, parts), ["_type", "_field", "_value"]
    names = [name for fields in passes for name, _ in fields]
    rules = parsed.filter(F.col("field").isin(names)).select(
        F.col("event_type").alias("_type"), F.col("field").alias("_field"), F.col("threshold").alias("_value"), "op", "rule_id")
    given = rules.unionByName(values.select(*point), allowMissingColumns=True)
    of = [(k, F.col("op") == op) for k, op in enumerate(OPS)]
    points = materialise(given.groupBy(*point).agg(
        F.bool_or(F.col("op").isNull()).alias("_asked"),
        *[F.count_if(mine).alias(f"_n{k}") for k, mine in of],
        *[F.sum(F.when(mine, F.col("_value"))).alias(f"_s{k}") for k, mine in of],
        *[F.min(F.when(mine, F.col("rule_id"))).alias(f"_r{k}") for k, mine in of]))
    found = split(points, ["_type", "_field"], ["_value"])
    for k, op in enumerate(OPS):
        if op != "=":
            found = prefix(found, {
                f"_all_n{k}": Running("sum", F.col(f"_n{k}")), f"_all_s{k}": Running("sum", F.col(f"_s{k}")), f"_all_r{k}": Running("min", F.col(f"_r{k}")),
            }, inclusive=op.endswith("="), reverse=op.startswith("<"))
    part = lambda x: [F.col(f"_{x}{k}" if op == "=" else f"_all_{x}{k}") for k, op in enumerate(OPS)]
    total = lambda x, zero: reduce(Column.__add__, [F.coalesce(c, F.lit(zero)) for c in part(x)])
    met = found.result().filter("_asked").select(
        *point, total("n", 0).alias("n_rules"), total("s", 0.0).alias("thresholds"), F.least(*part("r")).alias("first_rule")).filter("n_rules > 0")
    return _totals(join_lookup(values, met, point, "inner"), by)


def _totals(found: DataFrame, by: list[str]) -> DataFrame:
    count = F.coalesce(F.sum("n_rules"), F.lit(0)).alias("n_rules")
    return found.groupBy(*by).agg(count, F.sum("thresholds").alias("thresholds"), F.min("first_rule").alias("first_rule"))


def _columns(events: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in events.columns]
