"""Side-by-side run of a query and its oracle SQL on the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    return names, sorted(rows, key=_key)


def oracle_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in cur.fetchall()]
    return [cols[i] for i in order], sorted(rows, key=_key)


def difference(df, con, sql) -> str | None:
    """None when names, types and values agree; otherwise a short account."""
    names, a = spark_rows(df)
    onames, b = oracle_rows(con, sql)
    if names != onames:
        return f"columns {names} != {onames}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; spark {a[:3]} oracle {b[:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[:2]}" if bad else None
