"""Run a query and its oracle and compare them as sets of rows."""

import glob
import math
import os

import duckdb

from rudderql.sources.tables import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else glob.escape(p) + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    if v is None or isinstance(v, (int, str, bool)):
        return v
    if hasattr(v, "as_integer_ratio"):
        return float(f"{float(v):.9g}")
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: [(v is not None, str(type(v)), v) for v in r]
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=key)


def differences(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:2]
    return f"{len(got[1])} and {len(want[1])} rows; {odd}"
