"""Rows of a Spark frame and of DuckDB SQL in one form, whatever their order."""

import math
import os

import duckdb


def tables(folder: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
            con.execute(f"create view {f[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, int):
        return float(v)
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in df.collect())


def rows_of_duckdb(con, sql: str):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(repr([plain(r[k]) for k in order]) for r in got.fetchall())
