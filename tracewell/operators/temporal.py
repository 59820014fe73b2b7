"""Extras over time: as-of joins, joins of points with intervals, sessions, totals at all levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, order: str, value: list[str]) -> DataFrame:
    """left with the value columns of the last row of right, by (at, order), that has the same keys and is not after it; nulls where there is none.

    No join: both sides are put together, sorted once by key and time, and the last right row is carried forward, so the work is linear in the rows whatever their matches.
    A row of right at the same (at, order) counts. A key is sorted by one task, on disk if need be. Both sides may have null keys, which match.
    """
    kept = F.struct(*[F.col(v) for v in value])
    both = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.select(kept.alias("v")).schema["v"].dataType)})
    both = both.unionByName(right.select(*by, at, order, F.lit(0).alias("_side"), kept.alias("_value")), allowMissingColumns=True)
    upto = Window.partitionBy(*by).orderBy(at, order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_value", F.last("_value", ignorenulls=True).over(upto)).where("_side = 1")
    return found.select(*left.columns, *[F.col(f"_value.{v}").alias(f"last_{v}") for v in value])


def in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: Column, start: Column, end: Column, width: float) -> DataFrame:
    """Points joined with the intervals [start, end) of the same keys that hold them: an equi-join on bins of the given width, in each of which an interval stands once.

    The right width is about the length of most intervals: an interval is repeated for each bin that it touches.
    """
    bin_of = lambda x: F.floor(x / width)
    binned = intervals.withColumns({"_start": start, "_end": end}).where("_start < _end").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_start")), bin_of(F.col("_end")))))
    found = points.withColumn("_at", at).withColumn("_bin", bin_of(F.col("_at"))).join(binned, [*by, "_bin"])
    return found.where("_at >= _start and _at < _end").drop("_bin", "_at", "_start", "_end")


def sessions(rows: DataFrame, by: list[str], at: str, gap: str) -> DataFrame:
    """(by..., first, last, n): runs of rows of one key in which none comes later than `gap` after the one before; partial sessions are merged before the shuffle."""
    found = rows.where(F.col(at).isNotNull()).groupBy(*by, F.session_window(at, gap).alias("_s")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return found.drop("_s")


def levels(rows: DataFrame, by: list[str], *totals: Column) -> DataFrame:
    """Totals by every subset of the columns; `level` has a bit for each column that is summed over, which tells that from a null value."""
    return rows.cube(*by).agg(F.grouping_id().cast("long").alias("level"), *totals)
