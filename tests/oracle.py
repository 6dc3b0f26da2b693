"""Compares a query's rows with those of its SQL twin in DuckDB."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if v != v else (0.0 if abs(v) < 5e-7 else float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if names and rows agree, else what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} but SQL has {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return ""
    a, b = list((got - want).elements()), list((want - got).elements())
    return f"{sum(got.values())} rows, SQL {sum(want.values())}; {len(a)} only here, as {sorted(a, key=str)[:3]}; {len(b)} only in SQL, as {sorted(b, key=str)[:3]}"
