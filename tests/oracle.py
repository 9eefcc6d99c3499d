"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime as dt
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(path := f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    out = con.sql(sql)
    names = sorted(out.columns)
    at = [out.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=lambda r: tuple(map(str, r)))
