"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Every value is a whole number in ten-thousandths. A sketch is a table of counts by log-linear bin (the number with all
but its five highest bits cleared, so within 1/16 of it; exact below 32). Sketches merge by adding counts, in any order
and with one result, and have at most some 400 bins whatever the rows. They are made of the rows that pass the base rule.

A group's limits come from its sketch's quantiles. Word length and capitals, which all texts have, may lie `SPREADS`
times the distance between the quartiles beyond the nearer one, word length on both sides. Repeated lines and repeated
words, which most texts have none of, may be as far above a tail quantile (`TAILS`) as that is above the median. Half of a
group may be junk by its symbols, so their quantile is the median. `LEAST` is how far a limit is at least from the
median (for the first two: a share of it). It is the limit for symbols, and else binds where a group's texts are all
alike. Groups of fewer than `LEAST_ROWS` rows take the limits of the sketch merged over the language, or else over all rows.

Everything is DataFrame functions. Null texts have no words and so fail the base rule; null languages and sources are
groups of their own. Repeated rows count each. Extra columns stay as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventspark.llm.frames import keep

RULES = ("symbols", "letters", "capitals", "lines", "repeats")
#: Per cent and times its distance from the median beyond it.
TAILS = {"symbols": (50, 1), "lines": (99, 1), "repeats": (99, 1)}
TWO_SIDED = ("letters",)
#: Least distance from the median in ten-thousandths; symbols and words in repeated windows are per word, repeated lines per line.
LEAST = {"symbols": 3000, "lines": 500, "repeats": 500}
SPREADS, LEAST_SHARE, LEAST_ROWS = 5, 8, 100
#: Threshold rows that are broadcast, of some 100 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashes(words: Column) -> Column:
    """A hash of each 5-word window."""
    return F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(
        F.get(words, i + k) for k in range(5))))).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more.

    Windows are sorted by hash and place; those with an equal neighbour, back in order of place, add five words each,
    less what the one before covers.
    """
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = F.arrays_zip(placed.alias("own"), F.concat(none, placed).alias("before"), F.concat(F.slice(placed, 2, F.size(placed)), none).alias("after"))
    twice = F.filter(beside, lambda x: x["own"]["h"].eqNullSafe(x["before"]["h"]) & x["own"].isNotNull() | x["own"]["h"].eqNullSafe(x["after"]["h"]) & x["own"].isNotNull())
    places = F.sort_array(F.transform(twice, lambda x: x["own"]["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    return F.aggregate(places, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])


def figures_of(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals and n_lines (long)."""
    value = F.coalesce(text, F.lit(""))

    def of_windows(words: Column, hashes: Column) -> Column:
        lines = F.filter(F.split(value, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(value, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes)).cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(value, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
            F.size(lines).cast("long").alias("n_lines"))

    # Each transform over one element computes its value once and names it.
    words = F.array(F.array_remove(F.split(value, r"[\x20\x09-\x0D]+"), ""))
    both = F.transform(words, lambda w: F.struct(w.alias("w"), _hashes(w).alias("h")))
    return F.transform(both, lambda x: of_windows(x["w"], x["h"]))[0]


def base_failed(x: Column) -> Column:
    return (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])


def rule_values(x: Column) -> dict[str, Column]:
    """Each rule's value in ten-thousandths of a word or line."""
    words, lines = F.greatest(x["n_words"], F.lit(1)), F.greatest(x["n_lines"], F.lit(1))
    top = {"symbols": ("n_symbols", words), "letters": ("word_chars", words), "capitals": ("n_capitals", words), "lines": ("n_dup_lines", lines), "repeats": ("n_repeat_words", words)}
    return {rule: F.call_function("div", x[name] * 10000, of) for rule, (name, of) in top.items()}


def bin_of(value: Column) -> Column:
    """The number with all but its five highest bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(groups: DataFrame) -> DataFrame:
    """(lang, source, rule, bin, n) of rows with lang, source and x, their figures, that pass the base rule."""
    values = F.array(*(F.struct(F.lit(rule).alias("rule"), bin_of(value).alias("bin")) for rule, value in rule_values(F.col("x")).items()))
    rows = groups.where(~base_failed(F.col("x"))).select("lang", "source", F.explode(values).alias("v")).select("lang", "source", "v.rule", "v.bin")
    return rows.groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("n"))


def _limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the group and its limits from merged sketches, as low_<rule> and high_<rule> columns."""
    group = [*by, "rule"]
    merged = sketch.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    below = F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*group))
    counted = merged.select(*group, "bin", below.alias("below"), total.alias("total"))
    quantile = lambda p: F.min(F.when(100 * F.col("below") >= p * F.col("total"), F.col("bin"))).alias(f"q{p}")
    marks = counted.groupBy(*group).agg(F.first("total").alias("total"), *map(quantile, (25, 50, 75, 90, 99)))
    share = F.call_function("div", F.col("q50"), F.lit(LEAST_SHARE).cast("long"))
    wide = F.greatest(SPREADS * (F.col("q75") - F.col("q25")), share)

    def high(rule: str) -> Column:
        if rule not in TAILS:
            return F.col("q75") + wide
        p, times = TAILS[rule]
        t, m = F.col(f"q{p}"), F.col("q50")
        return F.greatest(t + times * (t - m), m + LEAST[rule])

    limits = [F.max(F.when(F.col("rule") == rule, high(rule))).alias(f"high_{rule}") for rule in RULES]
    limits += [F.max(F.when(F.col("rule") == rule, F.col("q25") - wide)).alias(f"low_{rule}") for rule in TWO_SIDED]
    return marks.groupBy(*by).agg(F.max("total").alias("total"), *limits)


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source with its limits; small groups have those of the language or of all rows."""
    names = [f"high_{rule}" for rule in RULES] + [f"low_{rule}" for rule in TWO_SIDED]

    def part(by: list[str], name: str) -> DataFrame:
        return _limits(sketch, by).select(*(F.col(c).alias(f"{name}_{c}") for c in by), F.struct(*names).alias(name), F.col("total").alias(f"{name}_n"))

    own, lang, everything = part(["lang", "source"], "own"), part(["lang"], "lang"), part([], "every")
    # The last has one row.
    joined = own.join(lang, own["own_lang"].eqNullSafe(lang["lang_lang"])).join(F.broadcast(everything), F.lit(True))
    limit = F.when(F.col("own_n") >= LEAST_ROWS, F.col("own")).when(F.col("lang_n") >= LEAST_ROWS, F.col("lang")).otherwise(F.col("every"))
    return joined.select(F.col("own_lang").alias("t_lang"), F.col("own_source").alias("t_source"), limit.alias("limits"))


def passes(x: Column, limits: Column) -> Column:
    values = rule_values(x)
    good = F.lit(True)
    for rule, value in values.items():
        good &= value <= limits[f"high_{rule}"]
        if rule in TWO_SIDED:
            good &= value >= limits[f"low_{rule}"]
    return good


def _with_limits(rows: DataFrame, lang: Column, source: Column, groups: DataFrame) -> DataFrame:
    limits = keep(thresholds(keep(sketches(groups))))
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    return rows.join(limits, lang.eqNullSafe(limits["t_lang"]) & source.eqNullSafe(limits["t_source"]), "left")


def quality_digest(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the base figures, base_failed and kept of every row. The texts are read once."""
    rows = keep(documents.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), figures_of(F.col(text)).alias("x")))
    judged = _with_limits(rows, rows["lang"], rows["source"], rows)
    x = F.col("x")
    return judged.select("doc_id", *(x[c].alias(c) for c in BASE), base_failed(x).alias("base_failed"), (~base_failed(x) & passes(x, F.col("limits"))).alias("kept"))


def keep_good(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that pass the base rule and the adaptive rules, with their columns as they are.

    Rows and their figures are kept in the shared folder, so that figures are worked out once.
    """
    whole = keep(documents.select(F.struct(*documents.columns).alias("row"), figures_of(F.col(text)).alias("x")))
    groups = whole.select(F.col(f"row.{lang}").alias("lang"), F.col(f"row.{source}").alias("source"), "x")
    judged = _with_limits(whole, whole["row"][lang], whole["row"][source], groups)
    return judged.where(~base_failed(F.col("x")) & passes(F.col("x"), F.col("limits"))).select("row.*")
