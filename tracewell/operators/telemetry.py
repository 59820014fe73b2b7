"""Run telemetry: running totals, estimates of time left, best so far, latest status.

Running values are windows over a run's own events in order; `run` columns keep the windows apart, so that no single task
sees the events of all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_rate(events: DataFrame, run: str, order: list[str], passed: Column) -> DataFrame:
    """Cumulative passes and pass rate after each event."""
    upto = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done, ok = F.count(F.lit(1)).over(upto), F.sum(passed.cast("bigint")).over(upto)
    return events.select("*", done.alias("done"), ok.alias("total_pass"), (ok / done).alias("pass_rate"))


def with_eta(rows: DataFrame, elapsed: Column, total: Column) -> DataFrame:
    """elapsed / done * (total - done)."""
    return rows.withColumn("eta", elapsed / F.col("done") * (total - F.col("done")))


def running_best(events: DataFrame, run: str, order: list[str], loss: str) -> DataFrame:
    """Least loss so far and whether this event improves it strictly."""
    before = F.min(loss).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return events.select("*", F.least(F.coalesce(before, F.col(loss)), F.col(loss)).alias("best"), F.coalesce(F.col(loss) < before, F.lit(True)).alias("improved"))


def latest(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """The last event of each run: one aggregation with partial results, no sort."""
    rest = [c for c in events.columns if c != run]
    return events.groupBy(run).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(run, "e.*")


def epoch_means(events: DataFrame, epoch: str, values: list[str]) -> DataFrame:
    return events.groupBy(epoch).agg(*[(F.sum(v) / F.greatest(F.count(v), F.lit(1))).alias(v) for v in values], F.count("*").alias("batches"))


def throughput(rows: DataFrame, by: str, tokens: str, seconds: str) -> DataFrame:
    return rows.groupBy(by).agg((F.sum(tokens) / F.sum(seconds)).alias("per_second"))
