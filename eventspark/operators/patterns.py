"""Sequences and thresholds over the ordered events of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.clock import micros
from eventspark.operators.ordered import Running, halo, prefix, split, trailing, without_halo

# A step is a name and the condition its event must meet.
Steps = list[tuple[str, Column]]


def _within(first: str, last: str, within: str) -> Column:
    return F.unix_micros(last) - F.unix_micros(first) <= micros(within)


def match_strict(df: DataFrame, key: str, steps: Steps, within: str, ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    """Consecutive events of a key that meet the steps one after another, the last within `within` of the first.

    One row per match: the key, and `<step>_id`, `<step>_ts` for each step.
    """
    rows = halo(split(df, [key], [ts, id_col]), after=len(steps) - 1)
    over = rows.window()
    found = F.lit(True)
    columns = {}
    for ahead, (name, condition) in enumerate(steps):
        met = F.coalesce(condition, F.lit(False))
        found = found & (met if ahead == 0 else F.coalesce(F.lead(met, ahead).over(over), F.lit(False)))
        columns[f"{name}_id"] = F.lead(id_col, ahead).over(over) if ahead else F.col(id_col)
        columns[f"{name}_ts"] = F.lead(ts, ahead).over(over) if ahead else F.col(ts)
    matched = without_halo(rows.df.withColumns({**columns, "_found": found}))
    first, last = steps[0][0], steps[-1][0]
    return matched.filter(F.col("_found") & _within(f"{first}_ts", f"{last}_ts", within)).select(key, *columns)


def match_relaxed(df: DataFrame, key: str, steps: Steps, within: str, ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    """Each first-step event with the next event of the second step, the next of the third after that, ...

    Other events may lie between. Every step is one backward running value, so the cost is linear.
    """
    rows = split(df, [key], [ts, id_col])
    following: Column | None = None
    for place in reversed(range(1, len(steps))):
        here = [F.col(id_col).alias("id"), F.col(ts).alias("ts")]
        if following is not None:
            here.append(following.alias("then"))
        name = f"_next_{place}"
        rows = prefix(
            rows, {name: Running("last", F.when(steps[place][1], F.struct(*here)))}, inclusive=False, reverse=True
        )
        following = F.col(name)
    columns = [F.col(id_col).alias(f"{steps[0][0]}_id"), F.col(ts).alias(f"{steps[0][0]}_ts")]
    path = "_next_1"
    for name, _ in steps[1:]:
        columns += [F.col(f"{path}.id").alias(f"{name}_id"), F.col(f"{path}.ts").alias(f"{name}_ts")]
        path += ".then"
    matched = rows.result().filter(steps[0][1]).select(key, *columns)
    last = f"{steps[-1][0]}_ts"
    return matched.filter(F.col(last).isNotNull() & _within(f"{steps[0][0]}_ts", last, within))


def match_threshold(
    df: DataFrame, key: str, condition: Column, n: int, within: str, ts: str = "timestamp"
) -> DataFrame:
    """Events meeting the condition when at least `n` such events of the key lie in the trailing `within`.

    Adds `match_count`.
    """
    counted = trailing(
        df.filter(condition), [key], ts, micros(within), {"match_count": F.lit(1).cast("long")}
    )
    return counted.filter(F.col("match_count") >= n)


def as_events(matches: DataFrame, key: str, steps: Steps, name: str, ts: str = "timestamp", id_col: str = "id", type_col: str = "type") -> DataFrame:
    """Matches in event shape: time of the last step, id made of the steps' ids."""
    return matches.select(
        F.col(key),
        F.concat_ws(">", *[F.col(f"{s}_id").cast("string") for s, _ in steps]).alias(id_col),
        F.col(f"{steps[-1][0]}_ts").alias(ts),
        F.lit(name).alias(type_col),
    )


def match_nested(
    df: DataFrame, key: str, inner: Steps, inner_name: str, outer: Steps, within: str, inner_within: str,
    ts: str = "timestamp", id_col: str = "id", type_col: str = "type", inner_strict: bool = False,
) -> DataFrame:
    """Relaxed match over events and the matches of an inner pattern, which appear as events of type `inner_name`."""
    match = match_strict if inner_strict else match_relaxed
    found = as_events(match(df, key, inner, inner_within, ts, id_col), key, inner, inner_name, ts, id_col, type_col)
    plain = df.select(key, F.col(id_col).cast("string").alias(id_col), ts, type_col)
    return match_relaxed(plain.unionByName(found), key, outer, within, ts, id_col)
