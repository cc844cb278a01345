"""Hashing, formatting and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 32 bit.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
_MASK = 0xFFFFFFFF

# The size literals that are understood; anything else means the default.
SIZES = {"1KB": 1024, "1MB": 1024 * 1024, "10MB": 10 * 1024 * 1024}
DEFAULT_SIZE = 10 * 1024 * 1024


def blank_to_null(value: Column) -> Column:
    """Empty text counts as missing; white space does not."""
    return F.nullif(value, F.lit(""))


def fnv1a32(value: Column) -> Column:
    """FNV-1a 32 of the UTF-8 bytes. An interpreted loop: apply it to distinct values only."""
    digits = F.hex(F.encode(value, "UTF-8"))
    places = F.sequence(F.lit(0), F.octet_length(value) - 1)

    def step(state: Column, place: Column) -> Column:
        byte = F.conv(F.substring(digits, place * 2 + 1, F.lit(2)), 16, 10).cast("long")
        return (state.bitwiseXOR(byte) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(_MASK))

    start = F.lit(FNV_OFFSET).cast("long")
    return F.when(F.octet_length(value) > 0, F.aggregate(places, start, step)).when(value.isNotNull(), start)


def format_error(name: str | Column, tag: str) -> Column:
    name = name if isinstance(name, Column) else F.lit(name)
    return F.concat(F.lit("Field '"), name, F.lit(f"' failed validation: {tag}"))


def parse_size(text: str | Column) -> int | Column:
    if isinstance(text, Column):
        size = F.lit(DEFAULT_SIZE)
        for literal, value in SIZES.items():
            size = F.when(text == literal, F.lit(value)).otherwise(size)
        return size.cast("long")
    return SIZES.get(text, DEFAULT_SIZE)


def extract_label(value: Column, pattern: str) -> Column:
    """First capture group; null when the pattern does not match."""
    return blank_to_null(F.regexp_extract(value, pattern, 1))


def render_template(body: Column, variables: Column) -> Column:
    """Replace every `${name}` in `body` by the map's value (missing values give empty text).

    The template is cut at its placeholders once, so a value that looks like one stays as it is. Names that the
    map lacks stay, too.
    """
    def filled(part: Column, place: Column) -> Column:
        end = F.locate("}", part)
        name = F.substring(part, F.lit(1), end - 1)
        known = (place > 0) & (end > 0) & F.coalesce(F.map_contains_key(variables, name), F.lit(False))
        rest = F.substring(part, end + 1, F.length(part))
        plain = F.when(place > 0, F.concat(F.lit("$"), F.lit("{"), part)).otherwise(part)
        return F.when(known, F.concat(F.coalesce(F.try_element_at(variables, name), F.lit("")), rest)).otherwise(plain)

    parts = F.split(body, r"\$\{")
    return F.when(variables.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(F.transform(parts, filled), ""))
