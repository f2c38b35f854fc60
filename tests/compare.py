"""Runs a query in Spark and its SQL in DuckDB and compares rows, order aside."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    return v


def rows(names, records) -> list[tuple]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in at) for r in records]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if not isinstance(x, list) else str(x)) for x in r))


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty when equal, otherwise what differs first."""
    df = fn(spark, sf_dir)
    got_names = df.columns
    got = rows(got_names, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = rows(want_names, res.fetchall())
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for g, w in zip(got, want):
        if g != w:
            names = sorted(got_names)
            bad = [(n, a, b) for n, a, b in zip(names, g, w) if a != b]
            return f"{sum(x != y for x, y in zip(got, want))} of {len(got)} rows differ, e.g. {bad}"
        for n, a, b in zip(sorted(got_names), g, w):
            if a is not None and type(a) is not type(b):
                return f"type of {n}: {type(a)} ({types[n]}) vs {type(b)}"
    return "" if got else "no rows"
