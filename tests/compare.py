"""Holds a registered query against its SQL in DuckDB: columns, types, rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

#: Spark's type names and DuckDB's.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


def connect(path: str):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = Path(path, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    c.execute("SET TimeZone = 'UTC'")
    return c


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), round(v, 3) if isinstance(v, float) and math.isfinite(v) else str(v)) for v in row)


def differences(df, sql: str, path: str) -> list[str]:
    """What differs; nothing where the two agree exactly."""
    got = connect(path).execute(sql)
    names, kinds = [d[0] for d in got.description], [str(d[1]) for d in got.description]
    theirs = got.fetchall()
    out = []
    order = sorted(df.columns)
    if order != sorted(names):
        return [f"columns {order} against {sorted(names)}"]
    found = dict(zip(names, kinds, strict=True))
    for c, kind in df.dtypes:
        if KINDS.get(kind, kind) != found[c]:
            out.append(f"type of {c}: {kind} against {found[c]}")
    at = {n: i for i, n in enumerate(names)}
    mine = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in order)).collect()), key=_key)
    theirs = sorted((tuple(r[at[c]] for c in order) for r in theirs), key=_key)
    if len(mine) != len(theirs):
        return [*out, f"{len(mine)} rows against {len(theirs)}"]
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    if bad:
        a, b = bad[0]
        out.append(f"{len(bad)} of {len(mine)} rows differ, first " + "; ".join(f"{c}: {x!r} against {y!r}" for c, x, y in zip(order, a, b, strict=True) if x != y))
    return out
