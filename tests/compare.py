"""Rows of a Spark query held against DuckDB's."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(df) -> tuple[list[str], list[str]]:
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(sql: str, folder: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())
