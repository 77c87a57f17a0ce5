"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def plain(value) -> str:  # noqa: ANN001
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, float) and value.is_integer():  # integers with nulls arrive as floats
        return str(int(value))
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if "bool" in type(value).__name__:
        return str(bool(value))
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False, name=None))


def compare(spark, query, sql: str, folder: str) -> None:  # noqa: ANN001
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    found, wanted = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
