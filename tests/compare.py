"""Compare a query with its SQL counterpart, row by row and type by type."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, str, dt.date, dt.datetime)):
        return value
    if isinstance(value, float):
        return ("float", float(f"{value:.12g}"))
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    raise TypeError(type(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, sql: str, con) -> list[str]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    expected_columns, expected = _rows(columns, found.fetchall())
    actual_columns, actual = _rows(df.columns, df.collect())
    if actual_columns != expected_columns:
        return [f"columns {actual_columns} != {expected_columns}"]
    problems = [f"only spark {n}x {row}" for row, n in list((actual - expected).items())[:3]]
    problems += [f"only sql {n}x {row}" for row, n in list((expected - actual).items())[:3]]
    if problems:
        problems.insert(0, f"rows {sum(actual.values())} vs {sum(expected.values())} {actual_columns}")
    return problems
