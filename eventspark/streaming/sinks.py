"""Sinks that give each row once, also when a micro-batch is run again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventspark.operators import store
from eventspark.operators.rules import match_rules, run_rules
from eventspark.operators.rollups import Aggs, merge_rollup, partial_rollup, rollup_values
from eventspark.operators.compaction import BATCH, compact, read_live, runs

def _others(spark: SparkSession, path: str, run: str) -> bool:
    """Whether the target has micro-batches of another checkpoint."""
    return bool(runs(spark, path) - {run})


def _start(
    stream: DataFrame, write: Callable[[DataFrame, str], None], checkpoint: str, trigger: dict, target: str | None = None,
) -> StreamingQuery:
    """Start a query whose micro-batches are named by the checkpoint's own id and their number.

    A new or reset checkpoint has another id and would start anew from its source. It neither replaces nor repeats
    what an earlier one wrote to `target`: such a target is refused, unless the option `beside=True` says that the
    stream's rows are others.
    """
    options = dict(trigger)
    beside = options.pop("beside", False)
    run: list[str] = []

    def named(batch: DataFrame, number: int) -> None:
        if not run:
            own = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
            if target and not beside and _others(batch.sparkSession, target, own):
                raise ValueError(f"{target} holds micro-batches that the checkpoint {checkpoint} does not know")
            run.append(own)
        write(batch, f"{run[0]}_{number}")

    writer = stream.writeStream.foreachBatch(named).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def _write_batch(batch: DataFrame, path: str, batch_id: str) -> None:
    # A micro-batch owns its folder, so running it again replaces what it wrote before.
    batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def write_exactly_once(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream so that replayed micro-batches change nothing and a restart resumes."""
    return _start(stream, lambda batch, i: _write_batch(batch, path, i), checkpoint, trigger, path)


def read_exactly_once(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the stream so far, each once, compacted or not."""
    return read_live(spark, path)


def append_history(
    stream: DataFrame, path: str, checkpoint: str, within_month: bool = False, **trigger
) -> StreamingQuery:
    """Append history rows to the month-partitioned table; ids already stored are skipped (see `append_events`).

    Rows without an id go to `<path>_rejected`, which a reset checkpoint would write again: one that has rows of another
    checkpoint is refused (see `_start`).
    """
    refused = f"{path.rstrip('/')}_rejected"

    def write(batch: DataFrame, batch_id: str) -> None:
        rejected = store.append_events(batch, path, within_month)
        if not rejected.isEmpty():
            _write_batch(rejected, refused, batch_id)

    return _start(stream, write, checkpoint, trigger, refused)


def write_rollup(
    stream: DataFrame, path: str, checkpoint: str, size: str, keys: list[str], aggs: Aggs, ts: str = "timestamp", **trigger
) -> StreamingQuery:
    """Maintain a rollup: each micro-batch stores the partial aggregates of its rows."""
    def write(batch: DataFrame, batch_id: str) -> None:
        _write_batch(partial_rollup(batch, size, keys, aggs, ts), path, batch_id)

    return _start(stream, write, checkpoint, trigger, path)


def read_rollup(spark: SparkSession, path: str, keys: list[str], aggs: Aggs) -> DataFrame:
    """The rollup as of now: the stored partial aggregates merged."""
    return rollup_values(merge_rollup(read_live(spark, path), keys, aggs), keys, aggs)


def compact_rollup(spark: SparkSession, path: str, keys: list[str], aggs: Aggs, **options) -> int:
    """Merge micro-batch folders of a rollup and their partial rows (see `compaction`)."""
    return compact(spark, path, lambda rows: merge_rollup(rows, keys, aggs), **options)


def run_rules_stream(
    stream: DataFrame, rules_path: str, path: str, checkpoint: str, view: str | None = None,
    type_col: str = "type", data: str = "data", **trigger,
) -> StreamingQuery:
    """Apply rules to each micro-batch, as the rule table stands when the micro-batch starts.

    With `view` the rules are SQL over the micro-batch under that name, otherwise threshold rules.
    """
    def write(batch: DataFrame, batch_id: str) -> None:
        spark = batch.sparkSession
        try:
            rules = spark.read.parquet(rules_path)
        except AnalysisException as error:
            raise ValueError(f"no rule table at {rules_path}") from error
        found = run_rules(spark, rules, {view: batch}) if view else match_rules(batch, rules, type_col, data)
        _write_batch(found, path, batch_id)

    return _start(stream, write, checkpoint, trigger, path)
