"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def shown(value) -> str:
    if isinstance(value, float):
        return f"{value:.8g}"
    if hasattr(value, "isoformat"):
        return str(value).replace("+00:00", "")
    return str(value)


def rows_of(records, columns, order) -> list[tuple]:
    at = [columns.index(c) for c in order]
    return sorted(tuple(shown(r[i]) for i in at) for r in records)


def compare(df, con, sql: str) -> int:
    """The number of rows; fails where columns or rows differ."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    wanted = rows_of(result.fetchall(), names, order)
    got = rows_of([tuple(r) for r in df.collect()], df.columns, order)
    assert len(got) == len(wanted)
    different = [(a, b) for a, b in zip(got, wanted, strict=True) if a != b]
    assert not different, different[:3]
    return len(got)
