"""Compare a query with its SQL in DuckDB on the same tables."""

import os

import duckdb
import pandas as pd


def _cell(v):
    if v is None or (not hasattr(v, "__iter__") and pd.isna(v)):
        return "-"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(_cell, r)) for r in frame[names].itertuples(index=False))


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    got, want = rows(query(spark, sf).toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
