"""Container logs (JSON in JSON) and plain log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.functions.text import extract_label

# Fixed value: the container name is the text before the first pipe of the tag.
CONTAINER_NAME = r"([^|]*)\|"


def parse_container_logs(df: DataFrame, line: str = "value", job: str = "containerlogs") -> DataFrame:
    """Log lines `{log, stream, time, attrs:{tag}}` to ts, labels and output; unparsable parts are null."""
    def part(path: str):
        return F.get_json_object(line, path)

    opened = df.select(
        F.try_to_timestamp(part("$.time")).alias("ts"),
        part("$.stream").alias("stream"),
        extract_label(F.get_json_object(part("$.attrs"), "$.tag"), CONTAINER_NAME).alias("container_name"),
        part("$.log").alias("output"),
    )
    return opened.withColumn("job", F.lit(job))


def read_logs(spark: SparkSession, path: str, job: str) -> DataFrame:
    """Text lines of log files with their path and a job label."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.lit(job).alias("job")
    )
