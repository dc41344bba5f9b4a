"""Run a query's SQL in DuckDB over the same tables, and compare rows."""

import math
import os

import duckdb


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6)) if math.isfinite(v) else repr(v)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def connection(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def rows_of_sql(con, sql):
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(x[i]) for i in order) for x in r.fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
