"""Compares a query with its SQL twin in DuckDB over the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(map(repr, (tuple(plain(r[i]) for i in order) for r in rows)))


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows_of(names, got.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if have == want:
        return ""
    a, b = set(have) - set(want), set(want) - set(have)
    return f"{len(have)} and {len(want)} rows; spark only {len(a)} {sorted(a)[:2]}; sql only {len(b)} {sorted(b)[:2]}"
