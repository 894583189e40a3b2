"""Run registered queries and their SQL twins side by side and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    made = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(made, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(df: DataFrame, sql: str, connection: duckdb.DuckDBPyConnection) -> str | None:
    """None where both agree, else a short account of the difference."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} vs {sorted(names)}"
    expected = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"row counts differ: {len(got)} vs {len(expected)}"
    for mine, theirs in zip(got, expected):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"{sorted(names)}\n  got      {mine}\n  expected {theirs}"
    return None
