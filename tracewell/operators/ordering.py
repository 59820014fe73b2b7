"""Global positions without a global window: a range sort, and a row per sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def materialized(df: DataFrame) -> DataFrame:
    """df computed once and stored reliably: in spark.checkpoint.dir, or under the warehouse where that is unset."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


def positions(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Add each row's place, from 0, in the given order. Ties are in no particular order, so `order` should end in a key.

    Rows are range-partitioned and sorted once and stored, so that places and the partitions' counts agree
    even if a task is run again; skewed values are no matter as long as the key tells rows apart.
    """
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    part = materialized(part)
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.col("_row") - F.call_function("shiftleft", F.col("_part").cast("bigint"), F.lit(33))
    return part.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_row", "_start")
