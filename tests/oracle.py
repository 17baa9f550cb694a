"""Runs a registered query beside its SQL and compares the rows."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str:
    """Empty if names, types' kinds and rows agree."""
    got = spark_df.collect()
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = rows_of(spark_df.columns, [tuple(r) for r in got]), rows_of(names, want.fetchall())
    if a == b:
        return ""
    x, y = a - b, b - a
    return f"{sum(a.values())} rows, {sum(b.values())} wanted; {sum(x.values())} differ: {sorted(map(str, x))[:3]} / {sorted(map(str, y))[:3]}"
