"""The given tables and the event views derived from them.

View texts are SQL that both engines read, so that a query and its stated result start from the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2024, 2, 1)

# Events with a source, tenants, trace ids and priorities; some lack a type, a source or a payload.
STD = """
SELECT CAST(event_id AS STRING) AS id,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS type,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('src-', CAST(user_id % 3 AS STRING)) END AS source,
  concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE props END AS data,
  ts AS timestamp, value, user_id, concat('corr-', CAST(event_id % 500 AS STRING)) AS correlation_id,
  CAST(event_id % 11 AS INT) AS priority, event_id FROM events
"""

# Requests: the value is the latency in milliseconds, the type the endpoint, the payload picks the status.
REQUESTS = """
SELECT event_id, ts, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
  concat('/', event_type) AS endpoint,
  CAST(CASE WHEN event_type = 'error' THEN 500 + event_id % 4 WHEN event_id % 9 = 0 THEN 400 ELSE 202 END AS INT) AS status,
  value / 1000.0 AS duration_seconds FROM events
"""

# A counter per type that restarts now and then.
COUNTER = """
SELECT ts, event_type AS metric, CAST(event_id % 400 AS DOUBLE) AS value, event_id FROM events
"""

ALERTS = """
SELECT event_id, ts, event_type AS alertname, CASE WHEN event_id % 10 = 0 THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('dev-', CAST(user_id % 5 AS STRING)) END AS dev,
  concat('host-', CAST(user_id AS STRING)) AS instance FROM events
"""

USER_EVENTS = "SELECT event_id, CAST(user_id AS STRING) AS userId, event_type AS action, ts FROM events"
ORDER_EVENTS = """
SELECT o_orderkey AS orderId, o_custkey AS userId, o_totalprice AS amount, o_orderdate AS ts FROM orders
"""

# Arrival order: time order with a bounded disorder; no two rows arrive at once.
ARRIVAL = "event_id + (event_id * 7919) % 50"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, text: str) -> DataFrame:
        """A view text over given tables, its times as UTC instants."""
        for name in ("events", "orders", "customer"):
            text = text.replace(f"FROM {name}", f"FROM parquet.`{self.sf_dir}/{name}.parquet`")
        df = self.spark.sql(text)
        local = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
        return df.withColumns({name: F.col(name).cast("timestamp") for name in local})

    @property
    def events(self) -> DataFrame:
        return self.view("SELECT * FROM events")

    @property
    def std(self) -> DataFrame:
        return self.view(STD)

    @property
    def requests(self) -> DataFrame:
        return self.view(REQUESTS)

    @property
    def alerts(self) -> DataFrame:
        return self.view(ALERTS)
