"""Rows of Spark and DuckDB side by side."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, float):
        return f"{x:.6f}"
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    out = con.execute(sql)
    return rows([d[0] for d in out.description], out.fetchall())
