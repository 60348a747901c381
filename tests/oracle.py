"""Runs a query and its SQL on the same parquet files."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10]
    return x


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(con, sql: str):
    got = con.sql(sql)
    names = sorted(got.columns)
    at = [got.columns.index(c) for c in names]
    return names, sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
