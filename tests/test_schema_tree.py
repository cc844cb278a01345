"""Schemas as paths: payload faults at any depth, versions compared by path, and JSON Schemas."""

import json

import pytest

from comparison import connect, duck_rows, spark_rows
from eventspark.operators import registry
from eventspark.operators.schema_tree import Envelope, problems, tree
from eventspark.plans import all_queries, all_sql

SCHEMAS = "schema_name string, schema_version int, schema_type string, schema_definition string, compatibility_level string, is_active boolean"


def record(*fields, name="R"):
    return {"type": "record", "name": name, "fields": [dict(zip(("name", "type", "default"), f)) for f in fields]}


def errors(spark, definition, payloads, kind="AVRO"):
    schemas = spark.createDataFrame([("t", 1, kind, definition if isinstance(definition, str) else json.dumps(definition), "BACKWARD", True)], SCHEMAS)
    rows = [(k, "t", 1, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)]
    events = spark.createDataFrame(rows, "i int, type string, schema_version int, data string")
    found = registry.check_payload(events, schemas).orderBy("i").collect()
    return [sorted(f"{e.field}:{e.code}" for e in r.payload_errors) for r in found]


def test_faults_at_any_depth(spark):
    inner = record(("x", "int"), ("y", ["null", "string"], None), name="I")
    deep = record(("a", record(("b", record(("c", "boolean"), name="C")), name="B")), ("list", {"type": "array", "items": inner}),
                  ("map", {"type": "map", "values": "I"}), ("e", {"type": "enum", "name": "E", "symbols": ["p", "q"]}), ("n", ["null", "I"], None))
    good = {"a": {"b": {"c": True}}, "list": [{"x": 1}, {"x": 2, "y": "s"}], "map": {"k": {"x": 1}}, "e": "p", "n": {"x": 3}}
    assert errors(spark, deep, [
        good, good | {"a": {"b": {"c": 1}}}, good | {"a": {}}, good | {"list": [{"x": 1}, {"x": "1"}, {"x": "1"}]}, good | {"list": [1]}, good | {"map": {"k": {"x": 2**40}}},
        good | {"e": "r"}, good | {"n": {"z": 1}}, good | {"n": None}, good | {"a": {"b": {"c": True, "d": 1}, "e": 2}}, good | {"list": {}}, "[1]", "{",
    ]) == [
        [], ["a.b.c:wrong_type"], ["a.b:missing"], ["list[].x:wrong_type"], ["list:wrong_type"], ["map{}.x:wrong_type"],
        ["e:wrong_type"], ["n.x:missing", "n.z:unknown"], [], ["a.b.d:unknown", "a.e:unknown"], ["list:wrong_type"], ["data:not_an_object"], ["data:not_an_object"],
    ]


def test_json_schemas_and_others(spark):
    schema = {
        "type": "object", "required": ["id", "items"], "additionalProperties": False, "$defs": {"item": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}},
        "properties": {"id": {"type": ["string", "integer"]}, "items": {"type": "array", "items": {"$ref": "#/$defs/item"}}, "kind": {"enum": ["a"], "type": "string"}, "any": {}},
    }
    assert errors(spark, schema, [
        {"id": 1, "items": []}, {"id": "x", "items": [{"n": 1, "more": 2}], "kind": "a", "any": [1]}, {"id": True, "items": [{}]}, {"items": 1, "kind": "b", "else": 0},
    ], "JSON") == [[], [], ["id:wrong_type", "items[].n:missing"], ["else:unknown", "id:missing", "items:wrong_type", "kind:wrong_type"]]
    assert errors(spark, "message M {}", [{}], "PROTOBUF") == errors(spark, "{", [{}]) == [["schema:unreadable"]]


def test_recursive_types_end():
    node = record(("next", ["null", "R"], None), ("v", "int"))
    assert set(tree(json.dumps(node)).nodes) == {"", "next", "v"}
    assert tree(json.dumps({"$ref": "#"}), "JSON").nodes[""].types == ("any",)


@pytest.mark.parametrize("old, new, found", [
    (("x", "int"), ("x", "long"), ["type_changed_back"]), (("x", ["null", "int"], None), ("x", "int"), ["type_changed"]),
    (("o", record(("x", "int"), name="O")), ("o", record(("x", "int"), ("y", "int", 0), name="O")), []),
    (("o", record(("x", "int"), name="O")), ("o", record(("x", "int"), ("y", "int"), name="O")), ["added_without_default"]),
    (("o", record(("x", "int"), ("y", "int"), name="O")), ("o", record(("x", "int"), name="O")), ["removed_without_default"]),
    (("o", {"type": "array", "items": record(("x", "int"), name="O")}), ("o", {"type": "array", "items": record(("x", "string"), name="O")}), ["type_changed", "type_changed_back"]),
    (("e", {"type": "enum", "name": "E", "symbols": ["a"]}), ("e", {"type": "enum", "name": "E", "symbols": ["b", "a"]}), ["type_changed_back"]),
    (("o", "int", 0), ("p", record(("x", "int"), name="P"), {}), []),
])
def test_versions_by_path(old, new, found):
    assert problems(tree(json.dumps(record(old))), tree(json.dumps(record(new)))) == found


def test_the_envelope_equals_all_pairs():
    kinds = ["int", "long", "string", ["null", "int"]]
    versions = [tree(json.dumps(record(*[(f, kinds[(k * 7 + i * 3) % 4], *[0] * ((k + i) % 3 == 0)) for i, f in enumerate("abc") if (k >> i) & 1], ("o", record(*[("x", kinds[k % 4])] * (k % 5 > 0), name="O"))))) for k in range(24)]
    seen = Envelope()
    for k, new in enumerate(versions):
        want = set()
        for old in versions[:k]:
            want |= set(problems(old, new))
        assert seen.problems(new) == want
        seen.add(new)


def test_transitive_levels(spark):
    rows = []
    for level in ("BACKWARD", "backward_transitive", "FORWARD_TRANSITIVE", "FULL_TRANSITIVE", "NONE", "ODD"):
        for v, fields in enumerate(([("a", "int", 1)], [], [("a", "string", "x")]), 1):
            rows.append((level, v, "AVRO", json.dumps(record(("k", "int"), *fields)), level, True))
        rows.append((level, 4, "AVRO", "{", level, True))
    found = registry.check_compat(spark.createDataFrame(rows, SCHEMAS)).collect()
    good = {(r.schema_name, r.schema_version) for r in found if r.is_compatible}
    assert good == {("BACKWARD", 2), ("BACKWARD", 3), ("NONE", 2), ("NONE", 3), ("NONE", 4)} | {
        (level, 2) for level in ("backward_transitive", "FORWARD_TRANSITIVE", "FULL_TRANSITIVE")}


@pytest.mark.parametrize("name", [
    "schema_compat", "schema_lineage", "payload_check", "payload_check_nested", "schema_compat_nested", "schema_compat_transitive", "breaking_events",
    "breaking_events_found", "upcast_payload", "bound_schema"])
def test_queries(spark, medium, name):
    assert spark_rows(all_queries()[name](spark, medium)) == duck_rows(connect(medium), all_sql()[name])
