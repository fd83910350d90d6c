"""Runs a query and its oracle side by side."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda x: "" if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else str(x)[:10] if hasattr(x, "year") else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__module__ == "numpy" and hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)
    return sorted(tuple(show(x) for x in row) for row in df.itertuples(index=False))


def difference(spark, name: str, sf_dir: str, queries: dict, sql: dict) -> str:
    got = queries[name](spark, sf_dir).toPandas()
    want = connection(sf_dir).sql(sql[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; only here {sorted(set(a) - set(b))[:3]}; only there {sorted(set(b) - set(a))[:3]}"
