"""URL filters by association rules: FP-growth over URL tokens and labels, pruned, matched by an inverted index.

A URL's tokens are its host's name parts one by one, the last two parts together, its path parts by depth (each run of
digits as one sign, and the first digit of a part that starts with one), the names of its query parts, and marks for a
fragment and a port. Labelled URLs make transactions of tokens and their label. FP-growth gives rules
`tokens -> label`; those of too small support or confidence go, and so does a rule when a part of its tokens gives the
same label with no less confidence. Of the rules that match a URL the most confident wins, then the better supported,
then block, then the first by its tokens; without a match the default holds.

Item sets of n tokens that stand together have 2**n parts, so tokens are bound before mining: those below the support
go, as FP-growth itself would do first, and tokens that the very same labelled rows have become one (the parts of a
site's template do); a rule with one of them holds for each. Where some row still has more than `MOST_TOKENS`, item sets
of at most `TOKENS_IN_RULE` tokens, which are all that rules need, are counted as combinations instead of by FP-growth,
which has no bound on their length.

Fixed rules come first: the longest that fits, of those whose host is the URL's or a parent domain and whose path the
URL's path starts with. Here they are also the labels that the method learns from.

Matching: each rule is listed under its rarest token. A URL's different tokens meet that index by a join, once for each
different token set, and the candidates are verified by their other tokens.

Null URLs, and those without `://`, have an empty host and path, no tokens, and get the default. Everything is
DataFrame functions and Spark's own FP-growth; repeated rows are learnt from and judged each.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.frames import free_name, keep, repeated

SUPPORT, CONFIDENCE, TOKENS_IN_RULE = 0.002, 0.9, 3
#: Tokens of a row, after merging, up to which FP-growth mines; 2**n item sets may be frequent.
MOST_TOKENS = 16
#: Host, path, verdict.
FIXED_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LABELS = ("label:allow", "label:block")


def host_of(url: Column) -> Column:
    """After the first `://` up to a slash, question mark, hash or the end, A-Z lowered; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    fits = F.array(*(
        F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(
            F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules))
    return F.array_max(fits)


def tokens_of(url: Column) -> Column:
    """The different tokens of a URL; none without a host."""
    host, path = host_of(url), path_of(url)
    name = F.regexp_replace(host, r":\d*$", "")
    parts = F.filter(F.split(name, r"\."), lambda x: x != "")
    n = F.size(parts)
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    shaped = F.transform(folders, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), F.regexp_replace(F.lower(x), r"\d+", "0")))
    digits = F.transform(folders, lambda x, i: F.concat(F.lit("digit"), i.cast("string"), F.lit(":"), F.regexp_extract(x, r"^(\d)", 1)))
    tokens = F.concat(
        F.transform(parts, lambda x: F.concat(F.lit("host:"), x)),
        F.when(n >= 2, F.array(F.concat(F.lit("site:"), F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), ".")))).otherwise(F.array().cast("array<string>")),
        shaped, F.filter(digits, lambda x: ~F.endswith(x, F.lit(":"))),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^([^=]*)", 1))),
        F.filter(F.array(
            F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), F.lit("mark:fragment")),
            F.when(F.rlike(host, F.lit(r":\d")), F.lit("mark:port"))), lambda x: x.isNotNull()))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tokens))


def merged(labelled: DataFrame, support: float) -> tuple[DataFrame, DataFrame, int]:
    """(`tokens` (of one name per group), `label`, `n`), (`token`, its group's `name`), and how many rows there are.

    `labelled` has `tokens`, `label` and `n`, each token set and label once. Groups are tokens of the same rows, told by
    sums of hashes over these; a group's name is its first token.
    """
    total = labelled.agg(F.sum("n")).first()[0]
    row = F.xxhash64("tokens", "label")
    each = labelled.select(row.alias("h"), F.xxhash64("label", "tokens").alias("g"), "n", F.explode("tokens").alias("token"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    of = each.groupBy("token").agg(F.sum("n").alias("n"), whole("h").alias("h"), whole("g").alias("g")).where(F.col("n") >= F.lit(support) * total)
    names = of.groupBy("n", "h", "g").agg(F.min("token").alias("name"))
    groups = keep(of.join(names, ["n", "h", "g"]).select("token", "name"))
    named = labelled.withColumn("id", F.xxhash64("tokens", "label")).select("id", "tokens", "label", "n", F.explode_outer("tokens").alias("token"))
    named = named.join(groups, "token", "left").groupBy("id", "tokens", "label", "n").agg(F.sort_array(F.collect_set("name")).alias("names"))
    baskets = named.groupBy(F.col("names").alias("tokens"), "label").agg(F.sum("n").alias("n"))
    return keep(baskets), groups, total


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = MOST_TOKENS) -> DataFrame:
    """(items, verdict, confidence, support) rules from rows of `tokens`, `label` (allow or block) and `n`, how often."""
    total = labelled.agg(F.sum("n")).first()[0]
    longest = labelled.agg(F.max(F.size("tokens"))).first()[0] or 0
    if longest <= most:
        rules = _grown(labelled, support, confidence)
    else:
        rules = _counted(labelled, total, support, confidence)
    rules = keep(rules)
    # Parts of at most TOKENS_IN_RULE tokens, so at most six a rule.
    parts = rules.select("items", "verdict", "confidence", F.explode(_parts(F.col("items"))).alias("part"))
    simpler = rules.select(F.col("items").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    worse = parts.join(simpler, "part").where("verdict = v AND c >= confidence").select("items", "verdict").distinct()
    return keep(rules.join(worse, ["items", "verdict"], "left_anti"))


def _grown(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """Rules by FP-growth, whose transactions are the rows themselves."""
    baskets = repeated(labelled, "n", "copy").select(F.concat("tokens", F.array(F.concat(F.lit("label:"), F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].isin(*LABELS))
    rules = rules.where(~F.arrays_overlap("antecedent", F.array(*map(F.lit, LABELS))) & (F.size("antecedent") <= TOKENS_IN_RULE))
    return rules.select(
        F.sort_array("antecedent").alias("items"), F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"), "confidence", "support")


def _counted(labelled: DataFrame, total: int, support: float, confidence: float) -> DataFrame:
    """The same rules from counts of all combinations of at most TOKENS_IN_RULE tokens, each different row once.

    Combinations grow by one token a step, and only from those that have the support.
    """
    rows = keep(labelled.select(F.xxhash64("tokens", "label").alias("id"), F.sort_array("tokens").alias("tokens"), "label", "n"))
    items = rows.select("id", "label", "n", "tokens", F.explode("tokens").alias("token")).withColumn("items", F.array("token"))
    found = None
    for size in range(1, TOKENS_IN_RULE + 1):
        if size > 1:
            later = F.filter("tokens", lambda t: t > F.element_at("items", -1))
            items = items.select("id", "label", "n", "tokens", "items", F.explode(later).alias("token")).withColumn("items", F.array_append("items", F.col("token")))
        counts = items.groupBy("items").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")])
        often = keep(counts.where(F.col("all") >= F.lit(support) * total))
        found = often if found is None else found.unionByName(often)
        items = items.join(often.select("items"), "items", "left_semi")
    each = found.select("items", "all", F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("both")) for v in ("allow", "block")])).alias("c"))
    rules = each.select("items", "c.verdict", (F.col("c.both") / F.col("all")).alias("confidence"), (F.col("c.both") / total).alias("support"))
    return rules.where((F.col("support") >= support) & (F.col("confidence") >= confidence))


def _parts(items: Column) -> Column:
    """The non-empty proper parts of an array of up to three, in its order."""
    one = F.transform(items, lambda x: F.array(x))
    two = F.transform(items, lambda x: F.array_remove(items, x))
    return F.when(F.size(items) == 1, F.array().cast("array<array<string>>")).when(F.size(items) == 2, one).otherwise(F.concat(one, two))


def match(token_sets: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(tokens, verdict) for the token sets that some rule matches. `counts` has how often each token occurs."""
    listed = rules.withColumn("id", F.xxhash64("items", "verdict")).select("*", F.explode("items").alias("token")).join(counts, "token")
    index = listed.groupBy("id", "items", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token"))["token"].alias("token")).drop("id")
    found = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    found = found.where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), F.when(F.col("verdict") == "block", 0).otherwise(1), "items", "verdict"))
    return found.groupBy("tokens").agg(best["verdict"].alias("learnt"))


def _judged(token_sets: DataFrame, rules: DataFrame, groups: DataFrame) -> DataFrame:
    """(tokens, learnt) of token sets some rule matches: rules are in names of groups, sets are told in them first."""
    named = token_sets.select("tokens", F.explode("tokens").alias("token")).join(groups, "token")
    named = keep(named.groupBy("tokens").agg(F.sort_array(F.collect_set("name")).alias("names")))
    different = named.select(F.col("names").alias("tokens")).distinct()
    counts = named.select(F.explode("names").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = match(different, rules, counts).select(F.col("tokens").alias("names"), "learnt")
    return named.join(found, "names").select("tokens", "learnt")


def judge(pages: DataFrame, url: str = "url", rules=FIXED_RULES, default: str = "allow", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """All rows and columns with `judged`: host, path, rule and verdict. Names that are taken get an underscore."""
    name, tokens = free_name(pages, "judged"), free_name(pages, "tokens")
    value = F.col(url)
    fixed = fixed_rule(host_of(value), path_of(value), rules)
    whole = pages.withColumn(tokens, F.sort_array(tokens_of(value)))
    # From here on each different token set once, with how many rows have it under which fixed verdict.
    sets = keep(pages.select(F.sort_array(tokens_of(value)).alias("tokens"), fixed["verdict"].alias("label")).groupBy("tokens", "label").agg(F.count("*").alias("n")))
    labelled = sets.where("label IS NOT NULL AND size(tokens) > 0")
    if labelled.isEmpty():
        learnt = sets.select("tokens", F.lit(None).cast("string").alias("learnt")).limit(0)
    else:
        baskets, groups, _ = merged(labelled, support)
        learnt = _judged(sets.where("label IS NULL").select("tokens").distinct(), mine(baskets, support, confidence), groups)
    learnt = learnt.select(F.col("tokens").alias("_set"), "learnt")
    joined = whole.join(learnt, whole[tokens] == learnt["_set"], "left")
    verdict = F.coalesce(fixed["verdict"], F.col("learnt"), F.lit(default))
    judged = F.struct(host_of(value).alias("host"), path_of(value).alias("path"), fixed["rule"].alias("rule"), verdict.alias("verdict"))
    return joined.select(*(whole[c] for c in pages.columns), judged.alias(name))


def url_digest(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    return judge(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))).select("page_id", "judged.*")
