"""Compare a query with its SQL on DuckDB, rows in any order."""

import os

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return c


def rows(df):
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA:
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return None if x != x else int(x) if x == int(x) else round(x, 6)
        return x if isinstance(x, int | str | bool) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)
