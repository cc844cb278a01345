"""Fixed schemas of the event envelope, records, and the configuration and history tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields.items()])


_S, _I, _L, _B, _D, _T = StringType(), IntegerType(), LongType(), BooleanType(), DoubleType(), TimestampType()
_STRING_MAP = MapType(_S, _S)

# Payloads are kept at rest as JSON text and opened with Variant functions.
EVENT = _struct(
    id=_S, type=_S, source=_S, subject=_S, tenant_id=_S, data=_S, timestamp=_T, version=_S,
    schema_version=_S, metadata=_STRING_MAP, correlation_id=_S, priority=_I,
)
REQUEST = _struct(type=_S, source=_S, subject=_S, data=_S, version=_S, metadata=_STRING_MAP)
TYPED_EVENT = _struct(
    id=_S, type=_S, source=_S, tenant_id=_S, data=_S, timestamp=_T, schema_version=_S,
    metadata=_STRING_MAP, correlation_id=_S, priority=_I,
)

HEADERS = ArrayType(_struct(key=_S, value=BinaryType()))
RECORD = _struct(topic=_S, key=_S, value=_S, headers=HEADERS, timestamp=_T)
TOPIC_ROW = _struct(key=_S, value=_S, headers=HEADERS, topic=_S, partition=_I, offset=_L, timestamp=_T)

STREAM_FRAME = _struct(
    event=TYPED_EVENT,
    ping=_struct(timestamp=_T),
    config=_struct(enable_compression=_B, batch_size=_I, flush_interval_ms=_I),
)

EVENTS_TABLE = _struct(
    event_id=_S, tenant_id=_S, event_type=_S, event_data=_S, event_timestamp=_T,
    processing_timestamp=_T, partition_key=_S, offset_info=_S, created_at=_T,
)
PROCESSED_EVENTS = _struct(
    original_event_id=_S, tenant_id=_S, rule_id=_S, result_type=_S, result_data=_S,
    processing_timestamp=_T, created_at=_T,
)
SCHEMAS = _struct(
    schema_name=_S, schema_version=_I, schema_type=_S, schema_definition=_S,
    compatibility_level=_S, is_active=_B, created_at=_T, updated_at=_T,
)
PROCESSING_RULES = _struct(
    rule_name=_S, rule_version=_I, rule_type=_S, rule_definition=_S, rule_config=_S,
    is_active=_B, created_at=_T, updated_at=_T,
)
OUTPUT_CONFIGS = _struct(
    config_name=_S, sink_type=_S, sink_config=_S, is_active=_B, created_at=_T, updated_at=_T,
)
DEAD_LETTERS = _struct(
    original_event_id=_S, tenant_id=_S, error_type=_S, error_message=_S, error_details=_S,
    retry_count=_I, max_retries=_I, next_retry_at=_T, original_event_data=_S, created_at=_T, updated_at=_T,
)

NOTIFICATION_TEMPLATE = _struct(
    id=_S, name=_S, subject=_S, body_template=_S, channel=_S, type=_S, version=_I, active=_B,
    created_at=_T, updated_at=_T,
)
NOTIFICATION_LOG = _struct(
    id=_S, template_id=_S, recipient=_S, channel=_S, status=_S, event_id=_S, payload=_S,
    error_message=_S, retry_count=_I, scheduled_at=_T, sent_at=_T, created_at=_T,
)
PREFERENCE = _struct(
    user_id=_S, email_enabled=_B, sms_enabled=_B, slack_enabled=_B, email_address=_S,
    phone_number=_S, slack_user_id=_S, subscribed_events=ArrayType(_S), updated_at=_T,
)

HTTP_REQUEST = _struct(ts=_T, method=_S, endpoint=_S, path=_S, status=_I, duration_seconds=_D)
SAMPLE = _struct(ts=_T, metric=_S, labels=_STRING_MAP, value=_D)
ALERT = _struct(ts=_T, alertname=_S, severity=_S, dev=_S, instance=_S)
