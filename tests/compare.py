"""Runs queries on Spark and their statements on DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_cell(row[k]) for k in order) for row in rows)


def difference(spark, con, build, sql: str, folder: str) -> str | None:
    """None if Spark and DuckDB give the same columns and the same bag of rows, else what differs."""
    df = build(spark, folder)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = _rows(df.columns, [tuple(row) for row in df.collect()])
    want = _rows(names, expected)
    if got == want:
        return None
    extra = [row for row in got if row not in set(want)][:3]
    missing = [row for row in want if row not in set(got)][:3]
    return f"{len(got)} rows != {len(want)}; only Spark: {extra}; only SQL: {missing}"
