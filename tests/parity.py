"""Comparing a query with its SQL in DuckDB."""

import math
import os


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return con


def cell(x):
    if isinstance(x, float) or hasattr(x, "as_tuple"):
        x = float(x)
        return "nan" if math.isnan(x) else repr(round(x, 5) + 0.0)
    return str(x)


def same(df, con, sql):
    names = sorted(df.columns)
    left = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    res = con.execute(sql)
    there = [d[0] for d in res.description]
    assert sorted(there) == names
    right = sorted(tuple(cell(r[there.index(c)]) for c in names) for r in res.fetchall())
    assert left == right
