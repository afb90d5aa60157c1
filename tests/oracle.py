"""Comparison of a Spark result with a DuckDB result: same columns, same rows in any order."""

import math
import os

import duckdb

DATA = "/root/testdata"


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def normal(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind in "fiub":
            df[k] = df[k].astype(float).round(6) + 0.0
        else:
            df[k] = df[k].map(_cell) if df[k].dtype == object else df[k].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark_df, duck_df):
    assert sorted(spark_df.columns) == sorted(duck_df.columns)
    assert len(spark_df) == len(duck_df)
    a, b = normal(spark_df), normal(duck_df)
    for k in a.columns:
        wrong = ~((a[k] == b[k]) | (a[k].isna() & b[k].isna()))
        assert not wrong.any(), (k, int(wrong.sum()), a[wrong].head(2).values.tolist(), b[wrong].head(2).values.tolist())
