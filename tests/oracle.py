"""Runs a query and its DuckDB SQL on the same tables and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
        return _plain(v.item())
    if isinstance(v, (float, int)):
        return round(float(v), 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def difference(query, sql: str, spark, sf_dir: str) -> str:
    """Empty when both give the same columns and rows."""
    got = query(spark, sf_dir).toPandas()
    want = tables(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    x, y = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only Spark {str(x)[:600]}; only SQL {str(y)[:600]}"
