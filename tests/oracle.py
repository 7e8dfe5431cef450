"""Rows of a query against the rows that DuckDB gives for its SQL."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """Values of both engines in one form; floats to nine digits."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "as_tuple"):
        return f"{float(value):.9g}"
    return f"{float(value):.9g}" if isinstance(value, int) else str(value)


def expected(folder, sql):
    """(sorted column names, counted rows) of sql over the tables in folder."""
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    by = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in by) for r in out.fetchall())


def actual(df):
    by = sorted(range(len(df.columns)), key=df.columns.__getitem__)
    return sorted(df.columns), Counter(tuple(plain(r[i]) for i in by) for r in df.collect())
