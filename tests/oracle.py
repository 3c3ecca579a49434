"""Compares a query with its SQL over the same tables."""

from __future__ import annotations

import pathlib

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in pathlib.Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW \"{p.stem}\" AS SELECT * FROM '{source}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        cells = []
        for v in row:
            if isinstance(v, (list, tuple)) or hasattr(v, "__len__") and not isinstance(v, str):
                cells.append(str(list(v)))
            elif v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
                cells.append(None)
            elif isinstance(v, float) or hasattr(v, "dtype") and getattr(v.dtype, "kind", "") == "f":
                cells.append(round(float(v), 5))
            else:
                cells.append(v)
        out.append(tuple(cells))
    return sorted(out, key=lambda r: tuple((c is None, str(type(c)), c if c is not None else 0) for c in r))


def compare(spark, folder: str, query, sql: str) -> None:
    mine = query(spark, folder).toPandas()
    theirs = connect(folder).execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    for a, b in zip(plain(mine), plain(theirs)):
        for x, y in zip(a, b):
            if isinstance(x, float) or isinstance(y, float):
                assert x == y or abs(float(x) - float(y)) <= 2e-5, (a, b)
            else:
                assert x == y, (a, b)
