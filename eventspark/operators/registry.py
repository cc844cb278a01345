"""Payload schemas stored as data: binding, checks, compatibility and evolution.

Schema definitions are Avro or JSON Schema texts (column `schema_type`; without it Avro), read as JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.operators.ordered import Running, prefix, split
from eventspark.operators.schema_tree import Envelope, problems, rules, tree
from eventspark.operators.sizes import join_lookup
from eventspark.sources.config import load_active

_DEFINITION = "struct<name string, fields array<struct<name string, type variant, `default` variant>>>"
NAME = ["schema_name", "schema_version"]

# The compatibility levels that are checked; others are refused.
LEVELS = ["BACKWARD", "FORWARD", "FULL", "NONE", "BACKWARD_TRANSITIVE", "FORWARD_TRANSITIVE", "FULL_TRANSITIVE"]
# Problems that break each compatibility level.
BACKWARD = ["added_without_default", "type_changed"]
FORWARD = ["removed_without_default", "type_changed_back"]


def _type_names(value: Column) -> Column:
    """Type of a field as a list: one name, or the members of a union.

    A complex type has its content after a colon: the items of an array or the values of a map, the symbols of an
    enumeration, the fields of a record.
    """
    def text(v: Column, path: str) -> Column:
        found = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.to_json(found))

    def name(v: Column) -> Column:
        kind = F.try_variant_get(v, "$.type", "string")
        content = (
            F.when(kind == "array", text(v, "$.items")).when(kind == "map", text(v, "$.values"))
            .when(kind == "enum", F.array_join(F.try_variant_get(v, "$.symbols", "array<string>"), ","))
            .when(kind == "record", text(v, "$.fields"))
        )
        return F.coalesce(
            F.when(content.isNotNull(), F.concat(kind, F.lit(":"), content)), kind,
            F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
        )

    union = F.try_variant_get(value, "$", "array<variant>")
    return F.when(union.isNotNull(), F.transform(union, name)).otherwise(F.array(name(value)))


def schema_fields(schemas: DataFrame) -> DataFrame:
    """One row per schema version with `fields`: array of (name, types, default, has_default)."""
    parsed = F.from_json("schema_definition", _DEFINITION)
    fields = F.transform(
        parsed["fields"],
        lambda f: F.struct(
            f["name"].alias("name"), _type_names(f["type"]).alias("types"),
            f["default"].alias("default"), f["default"].isNotNull().alias("has_default"),
        ),
    )
    return schemas.withColumn("fields", fields)


def bind_schema(events: DataFrame, schemas: DataFrame, type_col: str = "type") -> DataFrame:
    """Events with the schema of their type and `schema_version`; unknown ones have null schema columns."""
    renamed = schemas.withColumnRenamed("schema_version", "_version").filter("is_active")
    on = (F.col(type_col) == F.col("schema_name")) & (F.col("schema_version").cast("int") == F.col("_version"))
    return join_lookup(events, renamed, on, "left").drop("_version")


_RULE = ("array<struct<path string, kind string, open boolean, fields array<struct<name string, path string, kinds array<string>, "
         "optional boolean, small boolean, symbols array<string>>>>>")
_ERRORS = "array<struct<field:string,code:string>>"


def _typed(schemas: DataFrame) -> Column:
    return F.col("schema_type") if "schema_type" in schemas.columns else F.lit("AVRO")


def schema_rules(schemas: DataFrame) -> DataFrame:
    """Schema versions with `rules`, their flattened paths by the path that holds them (null: can't be read)."""
    @F.udf(_RULE, useArrow=True)
    def flat(definition: str, kind: str):
        return rules(tree(definition, kind))

    found = schemas.withColumn("_rules", flat("schema_definition", _typed(schemas)))
    by_path = F.map_from_entries(F.transform("_rules", lambda r: F.struct(r["path"], r.dropFields("path"))))
    return found.withColumn("rules", by_path).drop("_rules")


def _depth(schemas: DataFrame) -> int:
    """How many levels of objects, arrays and maps the schemas have."""
    level = F.array_max(F.transform(F.map_keys("rules"), lambda p: F.length(F.regexp_replace(p, r"[^.\[{]", "")) + F.when(p == "", 1).otherwise(2)))
    return schemas.select(level.alias("n")).agg(F.max("n")).first()[0] or 1


def _entered(path: Column, value: Column) -> Column:
    """A value to look into, with its members if it is an object."""
    return F.struct(path.alias("path"), value.alias("value"), F.try_variant_get(value, "$", "map<string,variant>").alias("members"))


def _children(at: Column, rules: Column) -> Column:
    """(rule of the member, value, where an error is told) of everything that one object, array or map holds."""
    rule = F.try_element_at(rules, at["path"])
    members = at["members"]
    only = F.get(rule["fields"], F.lit(0))

    def all_of(values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(only.alias("f"), v.alias("value"), at["path"].alias("told")))

    fields = F.transform(rule["fields"], lambda f: F.struct(f.alias("f"), F.try_element_at(members, f["name"]).alias("value"), f["path"].alias("told")))
    return (
        F.when(rule["kind"] == "record", F.when(members.isNotNull(), fields))
        .when(rule["kind"] == "map", all_of(F.map_values(members)))
        .otherwise(all_of(F.try_variant_get(at["value"], "$", "array<variant>"))))


def _fits(c: Column) -> Column:
    f, value = c["f"], c["value"]
    kind = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    in_range = ~f["small"] | (kind != "BIGINT") | F.try_variant_get(value, "$", "int").isNotNull()
    symbol = f["symbols"].isNull() | (kind != "STRING") | F.array_contains(f["symbols"], F.try_variant_get(value, "$", "string"))
    right = F.array_contains(f["kinds"], kind) & in_range & F.coalesce(symbol, F.lit(True))
    return F.coalesce(F.array_contains(f["kinds"], "ANY") | right, F.lit(False))


def _entry(name: Column, code: str) -> Column:
    return F.struct(name.alias("field"), F.lit(code).alias("code"))


def _unknown(at: Column, rules: Column) -> Column:
    rule = F.try_element_at(rules, at["path"])
    keys = F.map_keys(at["members"])
    left = F.array_except(keys, F.transform(rule["fields"], lambda f: f["name"]))
    told = F.transform(left, lambda k: _entry(F.when(at["path"] == "", k).otherwise(F.concat(at["path"], F.lit("."), k)), "unknown"))
    return F.when((rule["kind"] == "record") & ~rule["open"] & keys.isNotNull(), told).otherwise(F.array().cast(_ERRORS))


def with_errors(df: DataFrame, data: str, levels: int, name: str = "payload_errors") -> DataFrame:
    """Adds an array of (field, code): missing, wrong_type, unknown; the schema's paths are in column `rules`.

    The payload is parsed once and walked a level of the schema at a time; only values that fit are entered.
    """
    none = F.array().cast(_ERRORS)
    found = df.withColumn("_root", F.try_parse_json(data))
    found = found.withColumn("_at", F.when(F.col("rules").isNotNull(), F.array(_entered(F.lit(""), F.col("_root")))))
    is_object = F.get("_at", F.lit(0))["members"].isNotNull()
    found = found.withColumn("_errors", F.when(F.col("rules").isNotNull() & ~is_object, F.array(_entry(F.lit("data"), "not_an_object"))).otherwise(none))
    found = found.withColumn("_at", F.when(is_object, F.col("_at")))
    for _ in range(levels):
        found = found.withColumn("_held", F.flatten(F.filter(F.transform("_at", lambda at: _children(at, F.col("rules"))), lambda x: x.isNotNull())))
        judged = F.transform("_held", lambda c: F.struct(
            c["told"].alias("told"), c["f"]["path"].alias("path"), c["value"].alias("value"), c["f"]["optional"].alias("optional"),
            F.when(c["value"].isNotNull(), _fits(c)).alias("fits")))
        found = found.withColumn("_held", judged)
        wrong = F.array_compact(F.transform("_held", lambda c: F.when(c["value"].isNull() & ~c["optional"], _entry(c["told"], "missing")).when(
            ~c["fits"], _entry(c["told"], "wrong_type"))))
        unknown = F.flatten(F.transform("_at", lambda at: _unknown(at, F.col("rules"))))
        into = F.filter("_held", lambda c: c["fits"] & F.map_contains_key("rules", c["path"]))
        found = found.withColumns({
            "_errors": F.concat("_errors", F.coalesce(wrong, none), F.coalesce(unknown, none)),
            "_at": F.transform(into, lambda c: _entered(c["path"], c["value"]))})
    return found.withColumn(name, F.array_distinct("_errors")).drop("_root", "_at", "_errors", "_held")


def check_payload(events: DataFrame, schemas: DataFrame, type_col: str = "type", data: str = "data") -> DataFrame:
    """Events with `payload_errors` against their registered schema, and `schema_found`.

    Errors have the path of the field, `a.b` in a record, `a[].b` in an array of records; an item or a map's value of
    the wrong type counts against the array or map. A schema that can't be read is the error `unreadable` of `schema`.
    """
    slim = schema_rules(schemas).select(*NAME, "is_active", "rules").withColumn("_read", F.col("rules").isNotNull())
    bound = bind_schema(events, slim, type_col).withColumn("schema_found", F.col("schema_name").isNotNull())
    checked = with_errors(bound, data, _depth(slim))
    unread = F.array(_entry(F.lit("schema"), "unreadable"))
    checked = checked.withColumn("payload_errors", F.when(~F.col("_read"), unread).otherwise(F.col("payload_errors")))
    return checked.drop("schema_name", "is_active", "rules", "_read")


def _changes(schemas: DataFrame) -> DataFrame:
    """Versions after the first with `previous_version` and `changes` against it: an array of
    (field, change, old_types, new_types, old_default, new_default)."""
    slim = F.transform(
        "fields",
        lambda f: F.struct(f["name"].alias("name"), f["types"].alias("types"), f["has_default"].alias("has_default")),
    )
    versions = schema_fields(schemas).withColumn("fields", F.coalesce(slim, F.array()))
    last = F.struct(F.col("schema_version").alias("version"), F.col("fields").alias("fields"))
    ordered = split(versions, ["schema_name"], ["schema_version"])
    rows = prefix(ordered, {"_before": Running("last", last)}, inclusive=False).result()
    old, new = F.col("_before.fields"), F.col("fields")

    def named(fields: Column, name: Column) -> Column:
        return F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))

    both = F.transform(
        F.array_union(F.transform(old, lambda f: f["name"]), F.transform(new, lambda f: f["name"])),
        lambda name: F.struct(name.alias("field"), named(old, name).alias("o"), named(new, name).alias("n")),
    )
    compared = F.transform(
        both,
        lambda x: F.struct(
            x["field"].alias("field"),
            F.when(x["o"].isNull(), "added").when(x["n"].isNull(), "removed")
            .when(~x["o"]["types"].eqNullSafe(x["n"]["types"]), "type_changed").alias("change"),
            x["o"]["types"].alias("old_types"), x["n"]["types"].alias("new_types"),
            x["o"]["has_default"].alias("old_default"), x["n"]["has_default"].alias("new_default"),
        ),
    )
    later = rows.filter(F.col("_before").isNotNull()).withColumns(
        {"previous_version": F.col("_before.version"), "changes": F.filter(compared, lambda c: c["change"].isNotNull())}
    )
    return later.drop("_before", "fields")


def schema_lineage(schemas: DataFrame) -> DataFrame:
    """Field changes from each version to the next: `change` is added, removed or type_changed."""
    return _changes(schemas).select(*NAME, "previous_version", F.inline("changes"))


def _against(level: Column) -> Column:
    """The problems that a level doesn't allow."""
    level = F.regexp_replace(level, "_TRANSITIVE$", "")
    return (
        F.when(level == "BACKWARD", F.array(*map(F.lit, BACKWARD)))
        .when(level == "FORWARD", F.array(*map(F.lit, FORWARD)))
        .when(level == "FULL", F.array(*map(F.lit, BACKWARD + FORWARD)))
        .otherwise(F.array().cast("array<string>")))


def _transitive(versions: DataFrame) -> DataFrame:
    """(schema_name, schema_version, _all): problems against all earlier versions of the name.

    A name's versions pass one task in order, as a stream that keeps what all versions so far have had.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, before, read = None, Envelope(), True
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["schema_name"] != name:
                    name, before, read = row["schema_name"], Envelope(), True
                new = tree(row["schema_definition"], row["_type"])
                read = read and new is not None
                found.append(sorted(before.problems(new)) if read else ["unreadable"])
                if new is not None:
                    before.add(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["schema_name", "schema_version", "_all"])

    rows = versions.select(*NAME, "schema_definition", "_type").repartition("schema_name").sortWithinPartitions(*NAME)
    return rows.mapInArrow(walk, "schema_name string, schema_version int, _all array<string>")


def check_compat(schemas: DataFrame) -> DataFrame:
    """Each version after the first: `problems` against the one before and whether its level allows them.

    Versions are compared path by path at any depth. A transitive level counts the problems against all earlier
    versions. Levels count without regard to case; another level is the problem `unknown_level` and not compatible,
    and so is a schema text that can't be read (`unreadable`), unless the level is NONE.
    """
    versions = schemas.withColumn("_type", _typed(schemas)).withColumn("_level", F.upper(F.coalesce("compatibility_level", F.lit("BACKWARD"))))
    own = F.struct(F.col("schema_version").alias("version"), F.col("schema_definition").alias("text"), F.col("_type").alias("kind"))
    rows = prefix(split(versions, ["schema_name"], ["schema_version"]), {"_before": Running("last", own)}, inclusive=False).result()

    @F.udf("array<string>", useArrow=True)
    def compared(old: str, old_kind: str, new: str, new_kind: str):
        return problems(tree(old, old_kind), tree(new, new_kind))

    later = rows.filter(F.col("_before").isNotNull())
    later = later.withColumn("problems", compared("_before.text", "_before.kind", "schema_definition", "_type"))
    wide = versions.filter(F.col("_level").endswith("_TRANSITIVE")).select("schema_name").distinct()
    if not wide.isEmpty():
        whole = _transitive(versions.join(wide, "schema_name", "left_semi"))
        later = later.join(whole, NAME, "left").withColumn(
            "problems", F.when(F.col("_level").endswith("_TRANSITIVE"), F.col("_all")).otherwise(F.col("problems")))
    unknown = ~F.col("_level").isin(LEVELS)
    unread = F.array_contains("problems", "unreadable") & (F.col("_level") != "NONE")
    return later.select(
        *NAME, F.col("_before.version").alias("previous_version"), "compatibility_level",
        F.when(unknown, F.array_append("problems", F.lit("unknown_level"))).otherwise(F.col("problems")).alias("problems"),
        (~unknown & ~unread & ~F.arrays_overlap("problems", _against(F.col("_level")))).alias("is_compatible"))


def newest_schemas(schemas: DataFrame) -> DataFrame:
    return load_active(schemas, "schema_name", "schema_version")


def breaking_events(events: DataFrame, schemas: DataFrame, type_col: str = "type", data: str = "data") -> DataFrame:
    """Stored events per type and version, and how many the newest version cannot read.

    A field the newest schema does not know is no break (a reader skips it); a promotable number is none either.
    """
    newest = schema_rules(newest_schemas(schemas)).select(F.col("schema_name").alias("_name"), "rules")
    bound = join_lookup(events, newest, F.col(type_col) == F.col("_name"), "inner")
    errors = F.filter("_found", lambda e: e["code"] != "unknown")
    return with_errors(bound, data, _depth(newest), "_found").groupBy(F.col(type_col).alias("schema_name"), "schema_version").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if((F.size(errors) > 0) | F.col("rules").isNull()).alias("broken_count")
    )


def upcast(events: DataFrame, schemas: DataFrame, type_col: str = "type", data: str = "data") -> DataFrame:
    """Payloads as the newest version reads them: defaults filled, numbers promoted, dropped fields gone.

    Events without a registered schema are left alone.
    """
    newest = schema_fields(newest_schemas(schemas)).select(
        F.col("schema_name").alias("_name"), F.col("schema_version").cast("string").alias("_newest"), "fields"
    )
    bound = join_lookup(events, newest, F.col(type_col) == F.col("_name"), "left")
    members = F.try_variant_get(F.try_parse_json(data), "$", "map<string,variant>")

    def read(f: Column) -> Column:
        value = F.coalesce(F.try_element_at(members, f["name"]), f["default"])
        real = F.array_contains(f["types"], "double") | F.array_contains(f["types"], "float")
        number = F.schema_of_variant(value).startswith("BIGINT")
        promoted = F.try_parse_json(F.try_variant_get(value, "$", "double").cast("string"))
        return F.struct(f["name"].alias("key"), F.when(real & number, promoted).otherwise(value).alias("value"))

    pairs = F.filter(F.transform("fields", read), lambda p: p["value"].isNotNull())
    rebuilt = F.to_json(F.map_from_entries(pairs))
    known = F.col("_name").isNotNull() & members.isNotNull()
    return bound.withColumns(
        {
            data: F.when(known, rebuilt).otherwise(F.col(data)),
            "schema_version": F.when(known, F.col("_newest")).otherwise(F.col("schema_version").cast("string")),
        }
    ).select(*events.columns)
