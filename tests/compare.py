"""Rows of a Spark query beside those of its DuckDB form."""

import glob
import math
import os

import duckdb


def views(path):
    con = duckdb.connect()
    for t in glob.glob(f"{path}/*.parquet"):
        source = f"{t}/*.parquet" if os.path.isdir(t) else t
        con.sql(f"CREATE VIEW {os.path.basename(t)[:-8]} AS FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in found)


def check(spark, query, sql, path):
    df = query(spark, path)
    con = views(path)
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(other.columns, other.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
