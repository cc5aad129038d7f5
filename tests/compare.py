"""Rows of a query beside the rows of its DuckDB form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if not getattr(v, "hour", 0) and len(v.isoformat()) <= 19 and v.isoformat()[10:] in ("", "T00:00:00") else v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def order(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=order)


def duckdb_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=order)


def assert_same(df, sql: str, sf_dir: str):
    names, rows = spark_rows(df)
    want_names, want = duckdb_rows(sql, sf_dir)
    assert names == want_names
    assert len(rows) == len(want), (len(rows), len(want))
    differ = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not differ, f"{len(differ)} of {len(rows)} rows differ, first: {differ[0]}"
