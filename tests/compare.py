"""Compare a Spark result with its SQL twin in DuckDB, as unordered row sets."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def mismatch(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    names = df.columns
    got = rows_of(names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    oracle_names = [d[0] for d in cur.description]
    want = rows_of(oracle_names, cur.fetchall())
    if sorted(names) != sorted(oracle_names):
        return f"columns {sorted(names)} != {sorted(oracle_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if [type(x) for x in (got[0] if got else [])] != [type(x) for x in (want[0] if want else [])]:
        return f"types {got[0]} != {want[0]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]} of {sorted(names)}" if bad else None
