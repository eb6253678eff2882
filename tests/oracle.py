"""Comparison of a query with SQL that DuckDB runs on the same tables."""

import datetime
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(path):
    con = duckdb.connect()
    for name in sorted(os.listdir(path)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, Decimal):
        return int(v) if v == int(v) else round(float(v), 5)
    return v


def check(df, con, sql):
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    wanted = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert got == wanted
    return sum(got.values())
