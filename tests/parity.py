"""Spark against DuckDB on the same files."""

import glob
import math
from pathlib import Path

import duckdb


def connect(root):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{root}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in data)


def check(spark, root, name, queries, oracle):
    df = queries[name](spark, root)
    got = df.collect()
    if name in oracle:
        rel = connect(root).sql(oracle[name])
        assert table(df.columns, got) == table(rel.columns, rel.fetchall())
    return got
