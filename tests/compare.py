"""Rows of a Spark query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(v, 8) + 0.0) if isinstance(v, float) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_cell, r)) for r in frame[columns].itertuples(index=False))


def same(spark, con, query, sql, folder):
    assert rows(query(spark, folder).toPandas()) == rows(con.execute(sql).df())
