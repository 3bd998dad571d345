"""Comparison of a query's rows with its DuckDB SQL over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(value: object) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """What differs, or nothing."""
    got = df.collect()
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, want.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} and {b}"
    return None
