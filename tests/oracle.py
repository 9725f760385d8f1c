"""Compares a query's rows with its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    frame = con.execute(sql)
    return [d[0] for d in frame.description], frame.fetchall()


def same(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, int):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return a == b or abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(same(x, y, tolerance) for x, y in zip(a, b, strict=True))
    return a == b


def _order(row: tuple) -> list:
    return [(x is not None, f"{x:.6e}" if isinstance(x, float) else str(x)) for x in row]


def difference(df, sql: str, sf_dir: str, tolerance: float = 1e-9) -> str:
    """Empty if both have the same columns and rows; else what differs first."""
    names, want = rows_of_sql(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = [tuple(r) for r in df.select(*sorted(names)).collect()]
    at = [names.index(n) for n in sorted(names)]
    want = [tuple(r[i] for i in at) for r in want]
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for a, b in zip(sorted(got, key=_order), sorted(want, key=_order), strict=True):
        if not all(same(x, y, tolerance) for x, y in zip(a, b, strict=True)):
            return f"{dict(zip(sorted(names), a, strict=True))} and {dict(zip(sorted(names), b, strict=True))}"
    return ""
