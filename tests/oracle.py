"""Compares a query with its SQL twin in DuckDB, rows in any order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(canon(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (np.integer, np.bool_)):
        return x.item()
    if isinstance(x, (float, np.floating)):
        return round(float(x), 9)
    return x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(canon(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def assert_same(spark, sf_dir, build, sql):
    mine, twin = build(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(mine.columns) == sorted(twin.columns)
    assert rows(mine) == rows(twin)
