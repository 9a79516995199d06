"""Spark's rows of a query against DuckDB's, over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

SMALL = Path("/root/testdata/sf0.001")


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def value(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple(value(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False))


def same(spark, con, query, sql: str, folder: Path = SMALL) -> None:
    got, expected = query(spark, str(folder)).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
