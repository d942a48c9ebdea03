"""Comparing a query with its SQL on the same tables."""

from __future__ import annotations

import numbers

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> tuple[list[str], list[str]]:
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 9) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(map(cell, r))) for r in df[cols].itertuples(index=False))
