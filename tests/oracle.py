"""Compare a query's rows with its SQL's on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            c.execute(f"create view {t} as select * from '{path}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):  # compared bit by bit, so the sign of a zero counts
        return tuple(repr(x) if x == 0 and isinstance(x, float) else norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}


def difference(df, sql: str, c: duckdb.DuckDBPyConnection) -> str:
    """Empty if equal."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = c.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {bad[0]}"
    kinds = dict(zip(names, [str(d[1]) for d in res.description], strict=True))
    wrong = [(n, t, kinds[n]) for n, t in df.dtypes if t in KINDS and kinds[n] != KINDS[t] and not (t == "timestamp" and kinds[n] == "TIMESTAMP")]
    return f"types {wrong}" if wrong else ""
