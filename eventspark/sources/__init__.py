"""Sources: request bodies, typed events, stream frames, topics, history, configuration and logs."""

from eventspark.sources.config import load_active
from eventspark.sources.history import history_range, replay, scan_events
from eventspark.sources.logs import parse_container_logs, read_logs
from eventspark.sources.requests import decode_requests, explode_batch
from eventspark.sources.topic import read_event_topic
from eventspark.sources.typed import demux_frames, from_typed_events

__all__ = [
    "decode_requests", "demux_frames", "explode_batch", "from_typed_events", "history_range", "load_active",
    "parse_container_logs", "read_event_topic", "read_logs", "replay", "scan_events",
]
