"""The ordered core: cut and uncut keys give the same, whatever the skew."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from comparison import spark_rows
from eventspark.operators.ordered import BLOCKS_CONF, Running, halo, numbered, prefix, split, trailing, without_halo
from eventspark.plans.tables import Tables

HUGE, TINY = 10**9, 20
HOUR = 3_600_000_000


@pytest.fixture
def skewed(spark, small):
    spark.conf.set(BLOCKS_CONF, "100000")
    df = Tables(spark, small).events
    # Two thirds of the rows under one key, some under none.
    key = F.when(F.col("user_id") % 3 != 0, "hot").when(F.col("user_id") % 6 == 0, F.col("user_id").cast("string"))
    yield df.withColumn("k", key)
    spark.conf.unset(BLOCKS_CONF)


def both(make):
    plain, cut = make(HUGE), make(TINY)
    assert spark_rows(plain) == spark_rows(cut)


def test_keys_are_cut(skewed):
    blocks = split(skewed, ["k"], ["ts", "event_id"], TINY)
    assert blocks.cut
    sizes = blocks.df.groupBy("k", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] < 10 * TINY
    assert sizes.filter("k = 'hot'").count() > 10
    assert not split(skewed, ["k"], ["ts", "event_id"], HUGE).cut


def test_blocks_follow_the_order(skewed):
    blocks = split(skewed, ["k"], ["ts", "event_id"], TINY).df
    ends = blocks.groupBy("k", "_block").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    after = F.lead("low").over(Window.partitionBy("k").orderBy("_block"))
    assert ends.withColumn("next", after).filter("next <= high").count() == 0


def test_equal_order_values_stay_together(skewed):
    coarse = skewed.withColumn("day", F.to_date("ts"))
    blocks = split(coarse, ["k"], ["day"], TINY).df
    assert blocks.groupBy("k", "day").agg(F.countDistinct(F.coalesce("_block", F.lit(-1))).alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_prefix(skewed, reverse, inclusive):
    rare = F.when(F.col("event_id") % 97 == 0, F.col("event_id"))

    def make(limit):
        blocks = split(skewed, ["k"], ["ts", "event_id"], limit)
        values = {
            "n": Running("sum", F.lit(1)), "high": Running("max", F.col("value")), "low": Running("min", F.col("value")),
            "rare": Running("last", rare),
        }
        return prefix(blocks, values, inclusive=inclusive, reverse=reverse).result()

    both(make)


def test_halo(skewed):
    def make(limit):
        rows = halo(split(skewed, ["k"], ["ts", "event_id"], limit), before=45, after=3)
        w = rows.window()
        wide = rows.df.withColumns({
            "s": F.sum("event_id").over(w.rowsBetween(-45, 3)), "ahead": F.lead("event_id", 3).over(w),
        })
        return without_halo(wide)

    both(make)


@pytest.mark.parametrize("current", [True, False])
def test_trailing(skewed, current):
    values = {"n": F.lit(1).cast("long"), "views": (F.col("event_type") == "view").cast("long")}
    both(lambda limit: trailing(skewed, ["k"], "ts", 30 * HOUR, values, include_current=current, limit=limit))
    counted = trailing(skewed, ["k"], "ts", 30 * HOUR, values, include_current=current, limit=TINY)
    window = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-30 * HOUR, 0 if current else -1)
    stated = skewed.withColumns({n: F.coalesce(F.sum(v).over(window), F.lit(0)) for n, v in values.items()})
    assert spark_rows(counted) == spark_rows(stated)


def test_no_key_is_one_sequence(skewed):
    def make(limit):
        return numbered(split(skewed, [], ["ts", "event_id"], limit), "n").result()

    both(make)
    assert make(TINY).filter("n <> event_id + 1").count() == 0


def test_empty_input(skewed):
    none = skewed.filter("event_id < 0")
    assert numbered(split(none, ["k"], ["ts"]), "n").result().count() == 0
