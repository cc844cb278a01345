"""The event topic as a stream or a bounded read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventspark.schema import TOPIC_ROW

# The option that limits how much one micro-batch reads, per kind of source.
RATE_OPTION = {"kafka": "maxOffsetsPerTrigger", "parquet": "maxFilesPerTrigger", "json": "maxFilesPerTrigger"}


def read_event_topic(
    spark: SparkSession, source: str, fmt: str = "kafka", *, streaming: bool = True,
    max_per_trigger: int | None = None, **options: str,
) -> DataFrame:
    """Rows `key, value, headers, topic, partition, offset, timestamp`.

    `kafka` needs the connector on the class path (`source` is the topic, servers go in `options`);
    `parquet` and `json` read files with the same columns. `max_per_trigger` is the back-pressure limit.
    """
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if streaming and max_per_trigger is not None:
        reader = reader.option(RATE_OPTION[fmt], str(max_per_trigger))
    if fmt == "kafka":
        topic = reader.option("subscribe", source).option("includeHeaders", "true").load()
        return topic.selectExpr(
            "CAST(key AS STRING) key", "CAST(value AS STRING) value", "headers", "topic", "partition", "offset",
            "timestamp",
        )
    return reader.schema(TOPIC_ROW).load(source)
