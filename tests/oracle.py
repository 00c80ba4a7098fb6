"""Comparison of a query with its SQL oracle, order-insensitive, at 5 decimals."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"create view {f[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def same(df, con, sql):
    cols, mine = rows_of(df)
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = Counter(repr(tuple(plain(r[i]) for i in at)) for r in res.fetchall())
    assert mine == theirs, (list((mine - theirs))[:2], list((theirs - mine))[:2])
