"""Compare a registered query with its SQL in DuckDB, value by value."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import time

import duckdb


spark_seconds = 0.0


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v) if not isinstance(v, (list, tuple)) else repr([plain(x) for x in v])


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def kinds(names, records):
    """Column name -> the Python types its values take."""
    return {n: {type(r[i]).__name__ for r in records if r[i] is not None} for i, n in enumerate(names)}


def compare(df, con, sql) -> str | None:
    """None when equal, otherwise what differs."""
    global spark_seconds
    start = time.time()
    got = [tuple(r) for r in df.collect()]
    spark_seconds = time.time() - start
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = kinds(df.columns, got), kinds(names, want)
    if a != b:
        return f"types {[(k, a[k], b[k]) for k in a if a[k] != b[k]]}"
    left, right = rows(df.columns, got), rows(names, want)
    if left != right:
        only_l, only_r = sorted(set(left) - set(right))[:3], sorted(set(right) - set(left))[:3]
        return f"values: spark {only_l} sql {only_r}"[:1500]
    return None
