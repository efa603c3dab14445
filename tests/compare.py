"""Run a registered query and its SQL side by side and compare schema-named values."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, bool):
        return f"bool:{value}"
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(spark, query, sql, folder, limit=3):
    """An empty list when both sides agree exactly."""
    df = query(spark, folder)
    got_columns, got = sorted_rows(df.columns, df.collect())
    result = duck(folder).execute(sql)
    columns = [d[0] for d in result.description]
    want_columns, want = sorted_rows(columns, result.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}", f"spark {got[:limit]}", f"sql {want[:limit]}"]
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return [f"{len(wrong)} of {len(got)} rows differ", *map(str, wrong[:limit])] if wrong else []
