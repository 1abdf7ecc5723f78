"""Rows of a query and of its SQL, in a form that can be compared."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 8)
    return str(v)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def same(spark_rows, columns: list[str], found: duckdb.DuckDBPyRelation) -> bool:
    assert sorted(columns) == sorted(found.columns)
    return rows_of(columns, [tuple(r) for r in spark_rows]) == rows_of(found.columns, found.fetchall())
