"""The registered queries of this package and the SQL that states their results, where SQL can."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm.frames import small_batches
from eventspark.session import checkpoint_dir

_RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(function):
        _RUN[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP4 = r"""
WITH item AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(len(w), 10) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
gram AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM item)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
place AS (
  SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM gram))),
hit AS (SELECT r, i, place.size, item FROM place JOIN gram ON place.g = gram.g AND place.size = gram.size),
word AS (SELECT r, count(DISTINCT n) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS n FROM hit) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN found USING (r)
"""


@_query()
def op1_deleted_interpolation(spark, sf_dir):
    from eventspark.llm.interpolation import deleted_interpolation

    trains = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1
    return deleted_interpolation(_table(spark, sf_dir, "documents"), trains)


@_query(_OP4)
def op4_decontamination(spark, sf_dir):
    from eventspark.llm.decontamination import overlap_digest

    return overlap_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query()
def op2_jump_sharding(spark, sf_dir):
    from eventspark.llm.sharding import shard_digest

    return shard_digest(_table(spark, sf_dir, "documents"))


@_query()
def op7_tag_paths(spark, sf_dir):
    from eventspark.llm.tag_paths import text_digest

    return text_digest(_table(spark, sf_dir, "pages"))


@_query()
def op8_url_rules(spark, sf_dir):
    from eventspark.llm.url_rules import url_digest

    return url_digest(_table(spark, sf_dir, "pages"))


_OP3 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
gram AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM (
    SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc))),
repeated AS (
  SELECT r, count(DISTINCT n) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS n FROM gram WHERE times > 1) GROUP BY r),
fig AS (
  SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals, len(l) AS n_lines
  FROM doc LEFT JOIN repeated USING (r)),
value AS (
  SELECT r, lang, source, 'symbols' AS rule, n_symbols * 10000 // greatest(n_words, 1) AS v FROM fig UNION ALL
  SELECT r, lang, source, 'letters', word_chars * 10000 // greatest(n_words, 1) FROM fig UNION ALL
  SELECT r, lang, source, 'capitals', n_capitals * 10000 // greatest(n_words, 1) FROM fig UNION ALL
  SELECT r, lang, source, 'lines', n_dup_lines * 10000 // greatest(n_lines, 1) FROM fig UNION ALL
  SELECT r, lang, source, 'repeats', n_repeat_words * 10000 // greatest(n_words, 1) FROM fig),
binned AS (
  SELECT value.lang AS lang, value.source AS source, rule, CAST(v // (1::BIGINT << greatest(length(bin(v)) - 5, 0)) * (1::BIGINT << greatest(length(bin(v)) - 5, 0)) AS BIGINT) AS b
  FROM value JOIN fig USING (r) WHERE NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)),
mark AS (
  SELECT level, lang, source, rule, max(total) AS total, min(b) FILTER (100 * below >= 25 * total) AS q25, min(b) FILTER (100 * below >= 50 * total) AS q50,
    min(b) FILTER (100 * below >= 75 * total) AS q75, min(b) FILTER (100 * below >= 90 * total) AS q90, min(b) FILTER (100 * below >= 99 * total) AS q99
  FROM (
    SELECT *, row_number() OVER (PARTITION BY level, lang, source, rule ORDER BY b) AS below, count(*) OVER (PARTITION BY level, lang, source, rule) AS total
    FROM (SELECT 0 AS level, lang, source, rule, b FROM binned UNION ALL SELECT 1, lang, NULL, rule, b FROM binned
          UNION ALL SELECT 2, NULL, NULL, rule, b FROM binned)) GROUP BY ALL),
bound AS (
  SELECT level, lang, source, rule, total, CASE rule WHEN 'symbols' THEN q50 + 3000
    WHEN 'lines' THEN greatest(q99 + (q99 - q50), q50 + 500) WHEN 'repeats' THEN greatest(q99 + (q99 - q50), q50 + 500)
    ELSE q75 + greatest(5 * (q75 - q25), q50 // 8) END AS high,
    CASE rule WHEN 'letters' THEN q25 - greatest(5 * (q75 - q25), q50 // 8) ELSE -1 END AS low FROM mark),
pick AS (
  SELECT v.r, v.v, CASE WHEN o.total >= 100 THEN o.high WHEN l.total >= 100 THEN l.high ELSE e.high END AS high,
    CASE WHEN o.total >= 100 THEN o.low WHEN l.total >= 100 THEN l.low ELSE e.low END AS low
  FROM value v LEFT JOIN bound o ON o.level = 0 AND o.rule = v.rule AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source
  LEFT JOIN bound l ON l.level = 1 AND l.rule = v.rule AND l.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN bound e ON e.level = 2 AND e.rule = v.rule),
verdict AS (SELECT r, bool_and(v BETWEEN low AND high) AS good FROM pick GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  coalesce(NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND good, false) AS kept
FROM fig JOIN verdict USING (r)
"""


@_query(_OP3)
def op3_quality_rules(spark, sf_dir):
    from eventspark.llm.quality_rules import quality_digest

    return quality_digest(_table(spark, sf_dir, "documents"))


@_query()
def op5_packing(spark, sf_dir):
    import public_tokenizers

    from eventspark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query()
def op6_toxicity(spark, sf_dir):
    from eventspark.llm.toxicity import toxicity_digest

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return toxicity_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out)


@_query()
def op9_token_files(spark, sf_dir):
    import public_tokenizers

    from eventspark.llm.token_files import read_corpus, write_corpus

    path = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    write_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_corpus(spark, path)


@_query()
def op10_jaccard_forest(spark, sf_dir):
    from eventspark.llm.jaccard_forest import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


@_query()
def op11_periodic_runs(spark, sf_dir):
    from eventspark.llm.periodic_runs import runs_digest

    return runs_digest(_table(spark, sf_dir, "documents"))


@_query()
def op12_conversation_repair(spark, sf_dir):
    from eventspark.llm.conversation_repair import repair_digest

    return repair_digest(_table(spark, sf_dir, "conversations"))


@_query()
def op13_winnowing(spark, sf_dir):
    from eventspark.llm.winnowing import fingerprint_digest

    return fingerprint_digest(_table(spark, sf_dir, "documents"))


@_query()
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _reachable(spark: SparkSession) -> None:
    """Send this package to the workers where neither their start folder nor PYTHONPATH leads to it."""
    root = Path(__file__).resolve().parents[2]
    paths = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    sent = any(f.endswith("/eventspark-package.zip") for f in spark.sparkContext.listFiles)
    if not sent and root not in [p.resolve() for p in paths]:
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/eventspark-package", "zip", root, "eventspark")
        spark.sparkContext.addPyFile(made)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _reachable(spark)
            small_batches(spark)
            return function(spark, sf_dir)

        return run

    return {name: runner(function) for name, function in _RUN.items()}


def llm_sql() -> dict[str, str]:
    return dict(_SQL)
