"""JSON payloads as Variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_variant(text: Column) -> Column:
    """JSON text to Variant; null when it does not parse."""
    return F.try_parse_json(text)


def to_json_text(value: Column) -> Column:
    return F.to_json(value)


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def field(value: Column, name: str, dtype: str) -> Column:
    """A payload field as `dtype`; null when absent or of another kind."""
    return F.try_variant_get(value, f"$.{name}", dtype)


def config_value(config: Column, path: str) -> Column:
    """A value out of a JSON configuration text, such as a rule's threshold."""
    return F.get_json_object(config, path)
