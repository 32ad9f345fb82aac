"""Compare a query with its SQL oracle: columns, rows and values, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def difference(spark, sf_dir: str, query, sql: str, limit: int = 5) -> str:
    """Empty if equal."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    found = connect(sf_dir).execute(sql)
    have = [d[0] for d in found.description]
    if sorted(have) != names:
        return f"columns {names} against {sorted(have)}"
    at = [have.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    if got == want:
        return ""
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:limit]}; only there {sorted(b - a)[:limit]}"
