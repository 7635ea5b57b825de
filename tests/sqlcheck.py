"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, bool) or value is None or isinstance(value, (str, int, datetime.datetime)):
        return value
    number = float(value)
    return None if math.isnan(number) else round(number, 6)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def check(df, con, sql: str) -> None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    wanted = [tuple(plain(row[names.index(c)]) for c in order) for row in found.fetchall()]
    got = [tuple(plain(row[c]) for c in order) for row in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
