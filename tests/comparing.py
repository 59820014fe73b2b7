"""Holds a Spark result against DuckDB's on the same tables, whatever the order of rows and columns."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _cell(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return "NULL"
    return f"{v + 0.0:.10g}" if isinstance(v, float) else str(v)


def _plain(df):
    df = df[sorted(df.columns)].map(_cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark_df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    assert {c: KINDS.get(k, k) for c, k in spark_df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    pd.testing.assert_frame_equal(_plain(spark_df.toPandas()), _plain(rel.df()))
