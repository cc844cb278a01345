"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from eventspark.plans import all_queries
from eventspark.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# One or more of each kind of work; every one reads whole tables.
HEADLINE = [
    "validate_typed", "ingest_accepted", "ingest_batch_failfast", "ingest_batch_http", "request_decode", "batch_explode",
    "record_values", "record_offsets", "user_activity_hourly", "sliding_counts", "sessions_6h", "count_windows_10",
    "late_rows", "dedupe_events", "rollup_hourly", "latest_state", "match_strict_vcp", "match_relaxed_vcp",
    "fraud_threshold", "token_bucket", "fixed_window_limit", "enrich_nation", "interval_join_view_purchase",
    "correlate_traces", "type_correlation", "fraud_rule", "payload_check", "schema_compat", "quality_report", "mask_pii",
    "anomalies", "latency_quantile", "active_connections", "counter_rate", "alert_for", "alert_groups", "notify_fanout",
    "notify_status",
]


def main() -> None:
    spark = build_session(
        "bench", master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["user_activity_hourly"](spark, SF_DIR).count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
