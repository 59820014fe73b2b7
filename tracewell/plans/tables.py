"""Test tables in the shapes that the operators take, in Spark and as SQL.

orders are problems, their priority the difficulty; lineitem rows are samples, which have no unique key and
so are numbered by all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

SAMPLES_SQL = f"""samples AS (
  SELECT l_orderkey AS idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1 AS j,
         CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE CAST(floor(l_quantity * l_discount) AS BIGINT) END AS passed,
         CAST(l_quantity AS BIGINT) AS total, l_linestatus = 'O' AND l_quantity > 0 AS solved,
         CASE l_returnflag WHEN 'R' THEN 'runtime_error' WHEN 'A' THEN 'wrong_answer' ELSE 'timeout' END AS category
  FROM lineitem)"""
PROBLEMS_SQL = "problems AS (SELECT o_orderkey AS idx, CASE o_orderpriority WHEN '1-URGENT' THEN ' Easy' WHEN '2-HIGH' THEN 'Medium' WHEN '3-MEDIUM' THEN 'HARD ' WHEN '5-LOW' THEN '' ELSE o_orderpriority END AS difficulty FROM orders)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    j = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1
    open_ = F.col("l_linestatus") == "O"
    return rows.select(
        F.col("l_orderkey").alias("idx"), j.cast("long").alias("j"),
        F.when(open_, F.col("l_quantity")).otherwise(F.floor(F.col("l_quantity") * F.col("l_discount"))).cast("long").alias("passed"),
        F.col("l_quantity").cast("long").alias("total"), (open_ & (F.col("l_quantity") > 0)).alias("solved"),
        F.when(F.col("l_returnflag") == "R", "runtime_error").when(F.col("l_returnflag") == "A", "wrong_answer").otherwise("timeout").alias("category"),
    )


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    d = F.when(p == "1-URGENT", " Easy").when(p == "2-HIGH", "Medium").when(p == "3-MEDIUM", "HARD ").when(p == "5-LOW", "").otherwise(p)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), d.alias("difficulty"))
