"""Decode JSON request bodies, single and batch.

A body that does not parse, or a field of the wrong JSON kind, is `invalid_json`; a missing or null
field is left null for validation. Keys match without regard to case and unknown keys are ignored. Of a
key that repeats the last one counts, given the session's `spark.sql.variant.allowDuplicateKeys` as
`build_session` sets it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The error of a body that does not decode, the most events of a batch, the fields of a request.
INVALID_JSON = "invalid_json"
MAX_BATCH = 100
TEXT_FIELDS = ["type", "source", "subject", "version"]
FIELDS = [*TEXT_FIELDS, "data", "metadata"]


def _as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _pick(members: Column, name: str, folded: Column | None = None) -> Column:
    """A member by its exact name; only where `folded` says so are names compared without case."""
    exact = F.try_element_at(members, F.lit(name))
    matching = F.filter(F.map_entries(members), lambda pair: F.lower(pair["key"]) == name)
    loose = F.coalesce(exact, F.try_element_at(matching, F.lit(-1))["value"])
    return loose if folded is None else F.when(folded, loose).otherwise(exact)


def _has_folded(members: Column) -> Column:
    """Whether some key is a field's name in other than lower case."""
    return F.exists(F.map_keys(members), lambda key: ~key.isin(FIELDS) & F.lower(key).isin(FIELDS))


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _steps() -> list[Callable[[Column], Column]]:
    """From a Variant request to a struct (bad, type, source, subject, version, data, metadata).

    Each step is its own `transform` or projection, so that a value used several times is computed once.
    """
    def opened(v: Column) -> Column:
        return F.struct(v.alias("whole"), _as_map(v).alias("members"))

    def folded(r: Column) -> Column:
        return F.struct(r["whole"].alias("whole"), r["members"].alias("members"), _has_folded(r["members"]).alias("folded"))

    def picked(r: Column) -> Column:
        return F.struct(
            (r["whole"].isNull() | (r["members"].isNull() & ~F.is_variant_null(r["whole"]))).alias("bad"),
            *[_pick(r["members"], name, r["folded"]).alias(name) for name in FIELDS],
        )

    def checked(r: Column) -> Column:
        bad = r["bad"]
        for name in TEXT_FIELDS:
            bad = bad | ~(_absent(r[name]) | _is_text(r[name]))
        for name in ("data", "metadata"):
            bad = bad | (~_absent(r[name]) & _as_map(r[name]).isNull())
        labels = _as_map(r["metadata"])
        bad = bad | F.coalesce(F.exists(F.map_values(labels), lambda v: ~(_absent(v) | _is_text(v))), F.lit(False))
        return F.struct(bad.alias("bad"), *[r[name].alias(name) for name in FIELDS])

    def typed(r: Column) -> Column:
        good = ~r["bad"]
        text = lambda v: F.when(~_absent(v), F.try_variant_get(v, "$", "string"))
        labels = F.transform_values(_as_map(r["metadata"]), lambda _, v: F.coalesce(text(v), F.lit("")))
        return F.struct(
            r["bad"].alias("bad"),
            *[F.when(good, text(r[name])).alias(name) for name in TEXT_FIELDS],
            F.when(good & ~_absent(r["data"]), F.to_json(r["data"])).alias("data"),
            F.when(good, labels).alias("metadata"),
        )

    return [opened, folded, picked, checked, typed]


def _decoded(values: Column) -> Column:
    """An array of Variant requests as an array of structs."""
    for step in _steps():
        values = F.transform(values, step)
    return values


def decode_requests(df: DataFrame, body: str = "value") -> DataFrame:
    """One JSON request per row: adds the request fields and `decode_error`."""
    request = df.withColumn("_request", F.try_parse_json(body))
    for step in _steps():
        request = request.withColumn("_request", step(F.col("_request")))
    return request.select(
        *df.columns,
        *[F.col(f"_request.{name}").alias(name) for name in FIELDS],
        F.when(F.col("_request.bad"), F.lit(INVALID_JSON)).alias("decode_error"),
    )


def explode_batch(df: DataFrame, body: str = "value") -> DataFrame:
    """One batch envelope `{"events": [...]}` per row to one row per event with `idx`.

    A batch that does not decode, or holds no or more than 100 events, stays one row with `idx` null
    and the reason in `batch_error` / `batch_message`; it is not exploded.
    """
    envelope = (
        df.withColumn("_variant", F.try_parse_json(body))
        .withColumn("_members", _as_map(F.col("_variant")))
        .withColumn("_list", _pick(F.col("_members"), "events"))
        .withColumn("_items", F.try_variant_get(F.col("_list"), "$", "array<variant>"))
    )
    whole = F.col("_variant")
    bad_shape = (
        whole.isNull()
        | (F.col("_members").isNull() & ~F.is_variant_null(whole))
        | (~_absent(F.col("_list")) & F.col("_items").isNull())
    )
    requests = envelope.withColumn("_requests", _decoded(F.col("_items"))).withColumn(
        "_bad", bad_shape | F.coalesce(F.exists("_requests", lambda r: r["bad"]), F.lit(False))
    )
    count = F.size("_items")
    rule = (
        F.when(F.col("_items").isNull(), "required").when(count < 1, "min").when(count > MAX_BATCH, "max")
    )
    message = F.when(
        ~F.col("_bad"), F.concat(F.lit("Field 'Events' failed validation: "), rule)
    )
    error = F.when(F.col("_bad"), INVALID_JSON).when(rule.isNotNull(), "validation_failed")
    guarded = requests.select(
        *df.columns, error.alias("batch_error"), message.alias("batch_message"), "_requests"
    ).withColumn("_requests", F.when(F.col("batch_error").isNull(), F.col("_requests")))
    rows = guarded.select("*", F.posexplode_outer("_requests").alias("idx", "_request"))
    return rows.select(
        *df.columns, "batch_error", "batch_message", "idx",
        *[F.col(f"_request.{name}").alias(name) for name in FIELDS],
    )
