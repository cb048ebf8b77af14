"""Compares queries with their DuckDB SQL: schema names, row counts, sorted values."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else f"{x:.6f}" if isinstance(x, float) else str(x)[:10] if hasattr(x, "hour") and not x.hour and not x.minute else str(x) for x in r) for r in df.itertuples(index=False))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def differences(spark, folder: str, f, sql: str) -> str:
    got, want = f(spark, folder).toPandas(), connect(folder).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b) if x != y), "")
