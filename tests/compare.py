"""Rows of a Spark result and of DuckDB SQL in one comparable form."""

import os

import duckdb
import numpy as np


def form(x):
    if x is None:
        return "null"
    if isinstance(x, (float, np.floating)):
        return "nan" if x != x else f"{x + 0.0:.9g}"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(form(r[i]) for i in order) for r in data)


def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return con


def check(spark, folder, query, sql):
    mine = query(spark, folder)
    theirs = duck(folder).sql(sql)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(theirs.columns, theirs.fetchall())
