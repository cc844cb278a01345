"""Scalar functions; all of them build Spark column expressions."""

from eventspark.functions.clock import add_seconds, backoff, elapsed_ms, new_id, now_utc, parse_duration
from eventspark.functions.payload import config_value, field, is_object, to_json_text, to_variant
from eventspark.functions.text import blank_to_null, extract_label, fnv1a32, format_error, parse_size, render_template

__all__ = [
    "add_seconds", "backoff", "blank_to_null", "config_value", "elapsed_ms", "extract_label", "field",
    "fnv1a32", "format_error", "is_object", "new_id", "now_utc", "parse_duration", "parse_size",
    "render_template", "to_json_text", "to_variant",
]
