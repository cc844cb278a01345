"""The corpus pipeline: documents through five operators of eventspark.llm, each stage written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm.decontamination import decontaminate
from eventspark.llm.frames import small_batches
from eventspark.llm.jaccard_forest import one_of_each_class
from eventspark.llm.packing import pack_documents
from eventspark.llm.quality_rules import keep_good
from eventspark.llm.toxicity import drop_toxic
from eventspark.session import checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
#: Workers keep their memo of pieces through other stages, so it is a third of the usual one.
MEMO_PIECES = 300_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below one half; labels of the held-out fifth of the ids are not learnt from."""
    small_batches(spark)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the adaptive thresholds of their language and source."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of documents that links of similarity 0.8 or more connect."""
    small_batches(spark)
    return one_of_each_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside a window of a benchmark item."""
    small_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 token ids."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), pieces=MEMO_PIECES)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: A classifier, minima of hashes and a tokenizer are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
