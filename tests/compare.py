"""Comparison of a query's rows with another engine's."""

import datetime
import decimal
import glob
import os

import duckdb


def connect(directory):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{directory}/*.parquet"):
        c.execute(f"create view \"{os.path.basename(f)[:-8]}\" as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return repr(v) if isinstance(v, float) else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def sql_rows(c, sql):
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
