"""Compares a query with its SQL twin on DuckDB: columns by name, rows in any order, floats to nine digits."""

from __future__ import annotations

import math
from pathlib import Path


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, name: str, run, sql: str, sf_dir: str, con) -> str:
    """What differs; empty if nothing does."""
    df = run(spark, sf_dir)
    a = sorted_rows(df.columns, df.collect())
    con.execute(sql)
    names = [c[0] for c in con.description]
    b = sorted_rows(names, con.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else ""
