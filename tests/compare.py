"""Run a query in Spark and its SQL in DuckDB on the same tables, and compare row multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        pattern = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{pattern}')")
    return con


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(plain(value[k]) for k in value)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def rows(columns: list[str], data: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(df, sql: str, con) -> tuple[int, int, list, list]:
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns), (sorted(rel.columns), sorted(df.columns))
    theirs = rows(rel.columns, rel.fetchall())
    return sum(mine.values()), sum(theirs.values()), list((mine - theirs).items())[:4], list((theirs - mine).items())[:4]
