"""Threshold rules by the index against a plain loop over events and rules."""

import json
import math
import operator
import random

import pytest
from pyspark.sql import functions as F

from comparison import connect, duck_rows, spark_rows
from eventspark.operators import rule_index
from eventspark.operators.rules import match_rules, match_totals
from eventspark.plans import all_queries, all_sql
from eventspark.plans.configured import RULES

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}


def rule(name, kind, field, op, threshold, version=1, active=True):
    config = {"event_type": kind, "field": field, "threshold": threshold} | ({"op": op} if op else {})
    return (name, version, "THRESHOLD", "", json.dumps(config), active)


def found(spark, events, rules):
    frame = spark.createDataFrame(events, "id int, type string, data string")
    out = match_rules(frame, spark.createDataFrame(rules, RULES))
    assert out.columns == ["id", "type", "data", "rule_id", "threshold", "matched_value"]
    return sorted((r.id, r.rule_id, r.threshold, r.matched_value) for r in out.collect())


def value_of(data, field):
    at = json.loads(data)
    for part in field.split("."):
        at = at.get(part) if isinstance(at, dict) else None
    return float(at) if isinstance(at, (int, float)) and not isinstance(at, bool) else None


def test_ten_thousand_rules(spark):
    rng = random.Random(8)
    fields = ["a", "b.c", "b.d.e"]
    rules = [(f"r{k}", rng.choice("xyz"), rng.choice(fields), rng.choice([*OPS]), rng.choice([k % 50, k / 7, -1])) for k in range(10_000)]
    events = []
    for k in range(40):
        data = {"a": rng.choice([k, None, "n"]), "b": {"c": k / 7, "d": {"e": rng.randrange(50)}}}
        events.append((k, rng.choice("xyzw"), json.dumps(data)))
    want = []
    for i, kind, data in events:
        for name, on, field, op, limit in rules:
            v = value_of(data, field) if on == kind else None
            if v is not None and OPS[op](v, limit):
                want.append((i, name, float(limit), v))
    got = found(spark, events, [rule(*r) for r in rules])
    assert len(want) > 20_000 and got == sorted(want)


def test_values_and_configs(spark):
    rules = [
        rule("default", "t", "v", None, 1), rule("old", "t", "v", ">", 0), rule("old", "t", "v", ">", 5, version=2),
        rule("off", "t", "v", ">", 0, active=False), rule("odd", "t", "v", "!=", 0), rule("none", "t", "v", ">", None),
        rule("path", "t", "v'[", ">", 0), rule("list", "t", "l[1]", "=", 7), rule("nan", "t", "v", ">=", "NaN"), rule("twin", "t", "v", ">", 1),
        rule("other", "u", "v", ">", 0),
    ]
    rows = ['{"v":3}', '{"v":"6"}', '{"v":true}', '{"v":null}', "no json", None, '{"v":"NaN","l":[0,7]}', '{"v":1,"v":2}', '{"w":9}']
    got = found(spark, [(k, "t", x) for k, x in enumerate(rows)], rules)
    assert [(i, r) for i, r, *_ in got] == [
        (0, "default"), (0, "twin"), (1, "default"), (1, "old"), (1, "twin"), (6, "default"), (6, "list"), (6, "nan"), (6, "old"), (6, "twin"), (7, "default"), (7, "twin")]
    assert all(math.isnan(v) for i, r, _, v in got if i == 6 and r != "list")
    assert found(spark, [(0, "t", "{}")], []) == []


def test_payload_is_parsed_once_and_fields_go_in_passes(spark, monkeypatch, capsys):
    rules = [rule(f"r{k}", "t", f"f{k % 6}", ">", k) for k in range(300)]
    events = spark.createDataFrame([(1, "t", json.dumps({f"f{k}": 100 * k for k in range(6)}))], "id int, type string, data string")
    plan = match_rules(events, spark.createDataFrame(rules, RULES))
    plan.explain()
    assert capsys.readouterr().out.count("try_parse_json") <= 2  # shown at most once each by a projection and what reads it
    want = sorted((r.rule_id, r.matched_value) for r in plan.collect())
    assert len(want) == sum(100 * (k % 6) > k for k in range(300))
    monkeypatch.setattr(rule_index, "FIELDS_PER_PASS", 4)
    assert sorted((r.rule_id, r.matched_value) for r in match_rules(events, spark.createDataFrame(rules, RULES)).collect()) == want


def odd_case():
    rng = random.Random(5)
    limits = [*range(12), 2.5, -1, "NaN", "Infinity", "-Infinity", -0.0]
    rules = [rule(f"r{k}", rng.choice("xy"), rng.choice(["a", "b.c"]), rng.choice([*OPS]), rng.choice(limits)) for k in range(400)]
    values = [*range(-1, 13), 2.5, -0.0, None, "n", "NaN", "Infinity"]
    events = [(k % 50 or None, rng.choice(["x", "y", "z", None]), json.dumps({"a": rng.choice(values), "b": {"c": rng.choice(values)}})) for k in range(120)]
    return rules, [*events, *events[:20], (7, "x", None), (8, "x", "no json")]


@pytest.mark.parametrize("size", [1, 7, 512])
def test_blocks_of_rules_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(rule_index, "BLOCK_RULES", size)
    rules, events = odd_case()
    given = spark.createDataFrame(rules, RULES)
    frame = spark.createDataFrame(events, "id int, type string, data string")
    parsed = rule_index.parsed_rules(given)
    value = F.try_variant_get(F.try_parse_json("data"), "$.a", "string").try_cast("double")
    other = F.try_variant_get(F.try_parse_json("data"), "$.b.c", "string").try_cast("double")
    pairs = frame.crossJoin(parsed).withColumn("v", F.when(F.col("field") == "a", value).otherwise(other)).filter(
        "type = event_type AND ((op = '>' AND v > threshold) OR (op = '>=' AND v >= threshold) OR (op = '<' AND v < threshold)"
        " OR (op = '<=' AND v <= threshold) OR (op = '=' AND v = threshold))")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(match_rules(frame, given)) == rows(pairs.select("id", "type", "data", "rule_id", "threshold", F.col("v").alias("matched_value")))


@pytest.mark.parametrize("fields", [256, 1])
def test_totals_are_those_of_the_pairs(spark, monkeypatch, fields, request):
    if fields == 1:
        request.getfixturevalue("cut")
    monkeypatch.setattr(rule_index, "FIELDS_PER_PASS", fields)
    rules, events = odd_case()
    given = spark.createDataFrame(rules, RULES)
    frame = spark.createDataFrame(events, "id int, type string, data string")
    pairs = match_rules(frame, given).groupBy("id", "type").agg(
        F.count(F.lit(1)).alias("n_rules"), F.sum("threshold").alias("thresholds"), F.min("rule_id").alias("first_rule"))
    totals = match_totals(frame, given, ["id", "type"])
    assert totals.schema == pairs.schema
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(totals) == rows(pairs) and totals.count() > 40
    assert match_totals(frame, given.limit(0), ["id"]).collect() == []


def test_no_plan_row_holds_all_rules_of_a_type(spark):
    rules = spark.range(3000).selectExpr(
        "concat('r', id) AS rule_name", "1 AS rule_version", "'THRESHOLD' AS rule_type", "'' AS rule_definition",
        """concat('{"event_type":"t","field":"v","op":">","threshold":', id, '}') AS rule_config""", "true AS is_active")
    blocks = rule_index.in_blocks(rule_index.parsed_rules(rules))
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] == rule_index.BLOCK_RULES
    held = rule_index.build_index(blocks, ["v"]).selectExpr("size(_tests[0].limits) AS n").first().n
    assert held == math.ceil(3000 / rule_index.BLOCK_RULES)
    events = spark.range(2000).selectExpr("id", "'t' AS type", """concat('{"v":', id * 2, '}') AS data""")
    totals = match_totals(events, rules, ["id"])
    assert totals.agg(F.sum("n_rules")).first()[0] == sum(min(2 * k, 3000) for k in range(2000))
    assert match_rules(events, rules).count() == sum(min(2 * k, 3000) for k in range(2000))


@pytest.mark.parametrize("name", ["rule_index", "threshold_rules"])
def test_queries(spark, medium, name):
    assert spark_rows(all_queries()[name](spark, medium)) == duck_rows(connect(medium), all_sql()[name])
