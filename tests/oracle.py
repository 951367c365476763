"""Compares a query with its DuckDB oracle as the driver does: rows and columns without order."""

import os

import duckdb
import numpy as np
import pandas as pd


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        return round(float(x), 6) if isinstance(x, (float, int, np.number)) else x

    return list(frame.columns), sorted((tuple(cell(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


def duck(sql, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con.execute(sql).df()


def same(spark, query, sql, sf, name=""):
    got, want = rows_of(query(spark, sf).toPandas()), rows_of(duck(sql, sf))
    assert got[0] == want[0], (name, got[0], want[0])
    for a, b in zip(got[1], want[1]):
        assert a == b, (name, a, b)
    assert len(got[1]) == len(want[1]), (name, len(got[1]), len(want[1]))
