"""Run a registered query in Spark and its SQL in DuckDB and compare the rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else ("f", round(value, 6))
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, datetime.datetime):
        return ("t", value.isoformat())
    if isinstance(value, datetime.date):
        return ("dt", value.isoformat())
    return None if value is None else ("s", str(value))


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_value(row[i]) for i in order) for row in values]
    return [names[i] for i in order], sorted(table, key=repr)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    found = con.execute(sql)
    return rows([d[0] for d in found.description], found.fetchall())
