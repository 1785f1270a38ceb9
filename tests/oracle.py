"""Comparison of a DataFrame with DuckDB's rows for a statement, apart from the order of rows and columns."""

from __future__ import annotations

import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return c


def _plain(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(df, connection, sql: str) -> None:
    names = sorted(df.columns)
    got = _sorted(df.select(*names).collect())
    result = connection.execute(sql)
    have = [d[0] for d in result.description]
    assert sorted(have) == names
    at = [have.index(n) for n in names]
    want = _sorted(tuple(r[i] for i in at) for r in result.fetchall())
    assert len(got) == len(want)
    assert got == want
