"""Decoding, validation, ingestion and records on the fixture rows."""

import json

import pytest
from pyspark.sql import functions as F

from eventspark.operators import ingest as I
from eventspark.operators import records as R
from eventspark.operators import validate as V
from eventspark.schema import STREAM_FRAME, TYPED_EVENT
from eventspark.session import materialise
from eventspark.sources import decode_requests, demux_frames, explode_batch, from_typed_events

FULL = {
    "type": "user.created", "source": "test-service", "subject": "user/1",
    "data": {"user_id": "1", "email": "a@b.c", "name": "N"}, "metadata": {"region": "eu"},
}


def decode(spark, *bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, value string")
    return [r.asDict() for r in decode_requests(df).orderBy("n").collect()]


def test_valid_request(spark):
    (row,) = decode(spark, json.dumps(FULL))
    assert row["decode_error"] is None
    assert (row["type"], row["source"], row["subject"]) == ("user.created", "test-service", "user/1")
    assert json.loads(row["data"]) == FULL["data"] and row["metadata"] == {"region": "eu"}


def test_minimal_request_leaves_the_rest_empty(spark):
    (row,) = decode(spark, '{"type":"t","source":"s","data":{"key":"value"}}')
    assert row["subject"] is None and row["version"] is None and row["metadata"] is None


def test_nested_payload(spark):
    (row,) = decode(spark, '{"type":"t","source":"s","data":{"total_amount":299.99,"items":[{"id":1},{"id":2}]}}')
    assert json.loads(row["data"])["items"] == [{"id": 1}, {"id": 2}]


@pytest.mark.parametrize("body", [
    "invalid json", "", None, "[1]", "1", '{"type":1,"source":"s","data":{}}', '{"type":"t","source":"s","data":[]}',
    '{"type":"t","source":"s","data":"x"}', '{"type":"t","source":"s","data":{},"metadata":{"a":1}}',
    '{"type":"t","source":"s","data":{},"metadata":[]}', '{"type":"t","source":true,"data":{}}',
])
def test_wrong_kinds_are_invalid_json(spark, body):
    (row,) = decode(spark, body)
    assert row["decode_error"] == "invalid_json"
    assert row["type"] is None and row["data"] is None


def test_keys_match_without_case_and_extra_text_is_ignored(spark):
    rows = decode(spark, '{"TYPE":"t","Source":"s","DATA":{"a":1},"other":[1]}', '{"type":"t","source":"s","data":{}} tail')
    assert [(r["decode_error"], r["type"], r["source"]) for r in rows] == [(None, "t", "s")] * 2


def errors(spark, *bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, value string")
    return [r.error for r in V.validate_http(decode_requests(df)).orderBy("n").collect()]


def test_http_validation_tells_the_first_error(spark):
    message = "Field '{}' failed validation: required".format
    assert errors(
        spark, '{"type":"test.event"}', '{"type":"t","data":{}}', '{"source":"s"}', '{"type":"t","source":"s","data":null}',
        '{"type":"t","source":"s","data":{}}', '{"type":" ","source":"s","data":{}}', "null", '{"type":"","source":"","data":null}',
    ) == [message("Source"), message("Source"), message("Type"), message("Data"), None, None, message("Type"), message("Type")]


def typed(spark, *rows):
    return spark.createDataFrame([{"id": str(i), **r} for i, r in enumerate(rows)], TYPED_EVENT)


def test_typed_validation(spark):
    df = typed(
        spark, {"source": "s", "data": "{}"}, {"type": "t", "data": "{}"}, {"type": "t", "source": "s"},
        {"type": "t", "source": "s", "data": "{}"}, {},
    )
    found = [r.error for r in V.validate_typed(df).orderBy("id").collect()]
    assert found == [
        "event type is required", "event source is required", "event data is required", None, "event type is required",
    ]


def test_nil_event(spark):
    df = typed(spark, {}, {"type": "t", "source": "s", "data": "{}"}).withColumn("there", F.col("id") == "1")
    assert [r.error for r in V.validate_typed(df, "there").orderBy("id").collect()] == ["event cannot be nil", None]


def test_dry_run_reports_twice(spark):
    df = typed(spark, {"source": "s", "data": "{}"}, {"data": "{}"}, {"type": "t", "source": "s"}, {"type": "t", "source": "s", "data": "{}"})
    rows = V.validation_report(df).orderBy("id").collect()
    assert [len(r.errors) for r in rows] == [2, 3, 1, 0]
    assert [r.is_valid for r in rows] == [False, False, False, True]
    assert [e.code for e in rows[1].errors] == ["VALIDATION_FAILED", "REQUIRED_FIELD", "REQUIRED_FIELD"]
    assert all(r.warnings == [] for r in rows)


def test_typed_conversion(spark):
    full = {
        "type": "t", "source": "s", "tenant_id": "x", "data": '{"key":"value","number":42.0}', "schema_version": "v1",
        "metadata": {"a": "b"}, "correlation_id": "c", "priority": 1,
    }
    rows = from_typed_events(typed(spark, full, {"type": "t", "source": "s"})).orderBy("id").collect()
    assert {k: rows[0][k] for k in full} == full
    assert rows[1].data == "{}" and rows[1].timestamp is not None and rows[1].priority == 0


def test_frames(spark):
    event = {"id": "1", "type": "t", "source": "s", "data": "{}"}
    frames = [{"config": {"batch_size": 10}}] + [{"event": event}] * 5 + [{"event": {"id": "2", "type": "t"}}] + [{"ping": {"timestamp": None}}]
    events, responses = demux_frames(spark.createDataFrame(frames, STREAM_FRAME))
    rows = responses.collect()
    assert events.count() == 5 and len(rows) == 7
    assert sum(r.ack is not None for r in rows) == 5
    assert sum(r.pong is not None for r in rows) == 1
    assert [r.status.message for r in rows if r.status] == ["event source is required"]


def batch_rows(spark, body):
    return explode_batch(spark.createDataFrame([(1, body)], "batch_id int, value string")).orderBy("idx").collect()


def test_http_batches(spark):
    item = {"type": "t", "source": "s", "data": {}}
    rows = batch_rows(spark, json.dumps({"events": [item] * 3}))
    assert [(r.idx, r.batch_error, r.type) for r in rows] == [(i, None, "t") for i in range(3)]
    assert len(batch_rows(spark, json.dumps({"events": [item] * 100}))) == 100
    for body, error, message in [
        ({"events": []}, "validation_failed", "min"), ({}, "validation_failed", "required"), ({"events": None}, "validation_failed", "required"),
        ({"events": [item] * 101}, "validation_failed", "max"), ({"events": [item, 3]}, "invalid_json", None), ({"events": {}}, "invalid_json", None),
    ]:
        (row,) = batch_rows(spark, json.dumps(body))
        assert row.batch_error == error and row.idx is None
        assert row.batch_message == (message and f"Field 'Events' failed validation: {message}")


def test_http_batch_is_all_or_nothing(spark):
    good, bad = {"type": "t", "source": "s", "data": {}}, {"type": "t"}
    df = spark.createDataFrame(
        [(1, json.dumps({"events": [good] * 3})), (2, json.dumps({"events": [good, bad, {"source": "x"}]}))], "batch_id int, value string"
    )
    events, summary = I.ingest_batch_http(explode_batch(df), "batch_id", "idx")
    assert {r.batch_id for r in events.collect()} == {1} and events.count() == 3
    rows = {r.batch_id: r for r in summary.collect()}
    assert (rows[1].processed_count, rows[1].status_code, rows[1].error) == (3, 202, None)
    assert (rows[2].processed_count, rows[2].status_code) == (0, 400)
    assert rows[2].error == "Field 'Source' failed validation: required"


def test_typed_batch_is_partial(spark):
    df = typed(spark, {"type": ""}, {"source": "test"}).withColumns({"b": F.lit(1), "i": F.col("id").cast("int")})
    results = I.ingest_batch(df, "b", "i")
    summary = I.batch_summary(results, "b").first()
    assert (summary.success_count, summary.failure_count, summary.result_count) == (0, 2, 2)


def test_fail_fast_ends_at_the_first_failure(spark):
    good = {"type": "t", "source": "s", "data": "{}"}
    df = typed(spark, good, {}, good).withColumns({"b": F.lit(1), "i": F.col("id").cast("int")})
    assert [r.status for r in I.ingest_batch(df, "b", "i", fail_fast=True).orderBy("i").collect()] == ["ACCEPTED", "REJECTED"]
    failed = I.ingest_batch(df, "b", "i", send_failed=F.col("i") == 0).orderBy("i").collect()
    assert [r.status for r in failed] == ["FAILED", "REJECTED", "ACCEPTED"]
    assert failed[0].error_message == "failed to produce to Kafka"


@pytest.mark.parametrize("failures, sent", [
    ([False] * 3, [True] * 3), ([False, True], [True, False]), ([False, True, False], [True, False, False]), ([], []),
])
def test_sending_stops_at_the_first_failure(spark, failures, sent):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(failures)], "b int, i int, failed boolean")
    assert [r.sent for r in I.send_batch(df, "b", "i", "failed").orderBy("i").collect()] == sent


def test_defaults(spark):
    df = typed(spark, {"id": ""}, {"id": "given"}, {"id": None})
    ids = [r.id for r in materialise(V.with_defaults(df)).collect()]
    assert "given" in ids and len(set(ids)) == 3 and all(ids)
    fresh = materialise(V.with_defaults(df, always=True))
    assert "given" not in [r.id for r in fresh.collect()]
    assert [r.id for r in fresh.collect()] == [r.id for r in fresh.collect()]


def test_size_limits(spark):
    df = spark.createDataFrame([("x" * 10,), ("x" * 1024,), ("x" * 2048,), ("é" * 600,)], "body string")
    assert [r.too_large for r in V.limit_size(df, "1KB").collect()] == [False, False, True, True]
    assert not any(r.too_large for r in V.limit_size(df, "5 apples").collect())


def test_single_ingestion(spark):
    good = {"type": "t", "source": "s", "data": "{}", "priority": 5, "metadata": {"region": "eu", "test": "1"}}
    df = typed(spark, good, {"type": "t"}, {**good, "type": "u"}, good).withColumn("n", F.col("id").cast("int"))
    accepted, rejected = I.ingest(df, arrival=["n"])
    assert accepted.count() + rejected.count() == df.count()
    assert rejected.first().error_message == "event source is required"
    rows = accepted.orderBy("n").collect()
    assert rows[0].offset == 0 and rows[2].offset == 1 and rows[0].partition == rows[2].partition
    assert all(r.request_id for r in rows)


def test_http_ingestion(spark):
    bodies = [json.dumps(FULL), "invalid json", '{"type":"t"}']
    df = spark.createDataFrame([(i, b, "1.2.3.4", "agent", None) for i, b in enumerate(bodies)],
                               "n int, value string, client_ip string, user_agent string, request_id string")
    accepted, rejected = I.ingest(decode_requests(df), protocol="http", arrival=["n"])
    (row,) = materialise(accepted).collect()
    assert row.metadata == {"region": "eu", "request_id": row.request_id, "client_ip": "1.2.3.4", "user_agent": "agent"}
    assert row.id and row.timestamp and row.status == "ACCEPTED"
    messages = [r.error_message for r in rejected.orderBy("n").collect()]
    assert messages == ["invalid_json", "Field 'Source' failed validation: required"]


def test_record_json_leaves_empty_fields_out(spark):
    df = spark.createDataFrame(
        [("1", "t", "s", '{"key":"value"}', "2024-01-01T10:00:00.120Z", None, 0), ("2", "t", "s", None, "2024-01-01T10:00:00Z", "x", 3)],
        "id string, type string, source string, data string, at string, tenant_id string, priority int",
    ).withColumn("timestamp", F.col("at").cast("timestamp"))
    first, second = (json.loads(r.value) for r in R.to_records(df).orderBy("timestamp").collect()[::-1])
    assert first == {"id": "1", "type": "t", "source": "s", "data": {"key": "value"}, "timestamp": "2024-01-01T10:00:00.12Z"}
    assert second["data"] is None and second["priority"] == 3 and second["timestamp"] == "2024-01-01T10:00:00Z"
    record = R.to_records(df).filter("value LIKE '%\"id\":\"1\"%'").first()
    assert record.key == "t" and record.topic == "events"
    assert [(h.key, bytes(h.value)) for h in record.headers] == [("event_id", b"1"), ("event_type", b"t"), ("source", b"s")]


def fnv1a(text: str) -> int:
    state = 2166136261
    for byte in text.encode():
        state = ((state ^ byte) * 16777619) % 2**32
    return state


def test_partition_placement(spark):
    keys = ["user.created", "order.placed", "", "é", "x" * 60, "click", "view"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    found = {r.key: r.partition for r in R.with_partition(df, 12).collect()}
    for key in keys:
        signed = fnv1a(key) - 2**32 if fnv1a(key) >= 2**31 else fnv1a(key)
        assert found[key] == abs(int(signed / abs(signed)) * (abs(signed) % 12)), key


def test_offsets_are_dense(spark, small, cut):
    from eventspark.plans.tables import Tables

    df = R.with_partition(Tables(spark, small).events.withColumn("key", F.col("event_type")))
    placed = R.with_offsets(df, ["ts", "event_id"]).groupBy("partition").agg(
        F.min("offset").alias("low"), F.max("offset").alias("high"), F.countDistinct("offset").alias("n"))
    assert placed.filter("low <> 0 OR high <> n - 1").count() == 0
