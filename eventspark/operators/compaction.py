"""Micro-batch folders merged into larger ones, with a manifest that tells readers which are live.

A table that a stream writes has a folder per micro-batch, `batch_id=<run>_<number>`. Compaction writes the rows of
finished micro-batches to one folder under `_compacted` and then publishes a manifest, a small JSON file
`_manifest/<version>` that names the compacted folders and, for each run, the number up to which micro-batches are in
them. It is written beside and renamed into place; a version is never replaced, so of two compactions at once one
fails and changes nothing. What a reader sees is decided by the newest manifest alone:

    before the rename   the micro-batch folders, as if nothing had happened; the new folder is not named anywhere
    after it            the new folder; the covered micro-batch folders are skipped, and removed a version later

The newest micro-batch of a run may be written again after a failure, so it is never covered; a covered one that is
written again all the same stays skipped. Compacted folders have levels: `fanout` of one level are merged into one of
the next, so a table has some fanout x log(micro-batches) folders, and each row is rewritten once a level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"
FANOUT = 10
Merge = Callable[[DataFrame], DataFrame]


class Folder:
    """A table's folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.hadoop = self.jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self.hadoop.Path(self.path)
        self.fs = root.getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.fs.makeQualified(root).toUri(), conf)

    def at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def names(self, folder: str = "") -> list[str]:
        where = self.at(folder) if folder else self.hadoop.Path(self.path)
        if not self.fs.exists(where):
            return []
        return sorted(status.getPath().getName() for status in self.fs.listStatus(where))

    def read(self, name: str) -> str:
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return rows[0][0] if rows else ""

    def publish(self, name: str, text: str) -> None:
        """Write a file that must not exist; others see all of it or nothing."""
        beside = self.at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        self.context.rename(beside, self.at(name), none)

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass
class Manifest:
    """Compacted folders as (name, level), and for each run the number of the last micro-batch in them."""

    version: int = 0
    folders: list[tuple[str, int]] = field(default_factory=list)
    covered: dict[str, int] = field(default_factory=dict)

    def covers(self, batch: str) -> bool:
        run, _, number = batch.rpartition("_")
        return int(number) <= self.covered.get(run, -1)


def manifest(folder: Folder, version: int | None = None) -> Manifest:
    """The newest manifest (or one version); an empty one where nothing was compacted."""
    versions = [int(n) for n in folder.names("_manifest") if n.isdigit()]
    if not versions:
        return Manifest()
    version = max(versions) if version is None else version
    found = json.loads(folder.read(f"_manifest/{version:08d}"))
    return Manifest(version, [(n, level) for n, level in found["folders"]], found["covered"])


def batches(folder: Folder) -> list[str]:
    """All micro-batches that have a folder."""
    return [n.removeprefix(f"{BATCH}=") for n in folder.names() if n.startswith(f"{BATCH}=")]


def runs(spark: SparkSession, path: str) -> set[str]:
    """The runs (checkpoints) whose micro-batches the table holds."""
    folder = Folder(spark, path)
    return {b.rpartition("_")[0] for b in batches(folder)} | set(manifest(folder).covered)


def _read(folder: Folder, live: list[str], compacted: list[str]) -> DataFrame | None:
    parts = []
    if compacted:
        parts.append(folder.spark.read.parquet(*[f"{folder.path}/_compacted/{n}" for n in compacted]))
    if live:
        fresh = folder.spark.read.option("basePath", folder.path).option("mergeSchema", "false")
        parts.append(fresh.parquet(*[f"{folder.path}/{BATCH}={b}" for b in live]).withColumn(BATCH, F.col(BATCH).cast("string")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows as of now, each once; with the column `batch_id` unless a compaction's `merge` dropped it."""
    folder = Folder(spark, path)
    known = manifest(folder)
    found = _read(folder, [b for b in batches(folder) if not known.covers(b)], [n for n, _ in known.folders])
    return spark.read.parquet(path) if found is None else found  # which says what is wrong


def live_folders(spark: SparkSession, path: str) -> int:
    """How many folders a reader opens."""
    folder = Folder(spark, path)
    known = manifest(folder)
    return len(known.folders) + sum(not known.covers(b) for b in batches(folder))


def _finished(folder: Folder, known: Manifest, settled: bool) -> list[str]:
    """Micro-batches that can't be written again: of each run all but the newest, or all that are complete."""
    found = batches(folder)
    if settled:
        return [b for b in found if not known.covers(b) and "_SUCCESS" in folder.names(f"{BATCH}={b}")]
    newest = dict(known.covered)
    for b in found:
        run, _, number = b.rpartition("_")
        newest[run] = max(newest.get(run, -1), int(number))
    return [b for b in found if not known.covers(b) and int(b.rpartition("_")[2]) < newest[b.rpartition("_")[0]]]


def compact(
    spark: SparkSession, path: str, merge: Merge | None = None, fanout: int = FANOUT, settled: bool = False, step: Callable[[str], None] | None = None,
) -> int:
    """Compact once; returns the manifest's version. Does nothing with fewer than `fanout` finished micro-batches.

    `merge` makes fewer rows of the rows of several folders (a rollup's partial rows); rows stay as they are without
    it. `settled` says that no folder is ever written again, so that each run's newest is taken as well. One compaction
    at a time; `step` is told each step's name before it is taken.
    """
    tell = step or (lambda name: None)
    folder = Folder(spark, path)
    known = manifest(folder)
    ready = _finished(folder, known, settled)
    if len(ready) >= fanout:
        merged, level = list(known.folders), 0
        gone: list[str] = []
        # The highest level that fills up takes in all below it.
        while sum(lv == level for _, lv in merged) + 1 >= fanout:
            level += 1
        gone = [n for n, lv in merged if lv < level]
        rows = _read(folder, ready, gone)
        rows = merge(rows) if merge else rows.hint("rebalance")
        tell("write")
        name = f"{known.version + 1:08d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder.path}/_compacted/{name}")
        covered = dict(known.covered)
        for b in ready:
            run, _, number = b.rpartition("_")
            covered[run] = max(covered.get(run, -1), int(number))
        live = [[n, lv] for n, lv in merged if n not in gone] + [[name, level]]
        tell("publish")
        folder.publish(f"_manifest/{known.version + 1:08d}", json.dumps({"folders": live, "covered": covered}, sort_keys=True))
    tell("clean")
    clean(spark, path)
    return manifest(folder).version


def clean(spark: SparkSession, path: str) -> None:
    """Remove what neither the newest manifest nor the one before it names: readers of both go on.

    A folder that a compaction is writing now would go too; one compaction at a time.
    """
    folder = Folder(spark, path)
    known = manifest(folder)
    versions = sorted(int(n) for n in folder.names("_manifest") if n.isdigit())
    before = manifest(folder, versions[-2]) if len(versions) > 1 else Manifest()
    named = {n for n, _ in [*known.folders, *before.folders]}
    for name in folder.names("_compacted"):
        if name not in named:
            folder.remove(f"_compacted/{name}")
    for b in batches(folder):
        if before.covers(b):
            folder.remove(f"{BATCH}={b}")
    for version in versions[:-2]:
        folder.remove(f"_manifest/{version:08d}")
