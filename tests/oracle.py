"""Run queries beside their SQL over the same Parquet files."""

import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in sorted(os.listdir(folder)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str).replace("NaT", "NULL")
    blank = lambda x: x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x)
    df = df.map(lambda x: "NULL" if blank(x) else repr(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def plan_of(spark_df):
    return spark_df._jdf.queryExecution().executedPlan().toString()


def same(spark_df, con, sql):
    plan = plan_of(spark_df)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    ours, theirs = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(plain(ours), plain(theirs))
