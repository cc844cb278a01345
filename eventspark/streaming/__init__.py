"""Structured Streaming: sinks that survive replays, rules read afresh, and stateful operators.

Windows, sessions, deduplication, enrichment, interval joins and frame handling take a stream in
their batch functions; here is what needs a stream of its own.
"""

from eventspark.streaming.sinks import (
    append_history, compact_rollup, read_exactly_once, read_rollup, run_rules_stream, write_exactly_once, write_rollup,
)
from eventspark.streaming.stateful import (
    stream_alert_groups, stream_count_windows, stream_late, stream_match_relaxed, stream_match_strict, stream_threshold,
    stream_token_bucket,
)

__all__ = [
    "append_history", "compact_rollup", "read_exactly_once", "read_rollup", "run_rules_stream", "stream_alert_groups",
    "stream_count_windows", "stream_late", "stream_match_relaxed", "stream_match_strict", "stream_threshold", "stream_token_bucket",
    "write_exactly_once", "write_rollup",
]
