"""Comparison of models on the same problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def role(name: Column) -> Column:
    """original / distilled by substring, then Teacher by prefix, else the name itself."""
    low = F.lower(name)
    return F.when(low.contains("original"), "original").when(low.contains("distilled"), "distilled").when(low.startswith("teacher"), "teacher").otherwise(name)


def compare_roles(outcomes: DataFrame) -> DataFrame:
    """(idx, role, solved) -> one row per problem; an absent role counts as not solved. A single aggregation instead of outer joins."""
    had = lambda r: F.coalesce(F.bool_or(F.when(F.col("role") == r, F.col("solved"))), F.lit(False))
    wide = outcomes.groupBy("idx").agg(had("original").alias("original"), had("distilled").alias("distilled"), had("teacher").alias("teacher"))
    return wide.select(
        "*", (F.col("distilled") & ~F.col("original")).alias("gained"), (F.col("original") & ~F.col("distilled")).alias("regressed"),
        (~F.col("teacher") & ~F.col("distilled")).alias("unreachable"), (F.col("teacher") & ~F.col("distilled")).alias("reachable_miss"),
    )


def comparison_counts(compared: DataFrame) -> DataFrame:
    names = ["gained", "regressed", "unreachable", "reachable_miss"]
    return compared.agg(F.count("*").alias("problems"), *[F.count_if(n).alias(n) for n in names])


def comparison_ids(compared: DataFrame) -> DataFrame:
    """(list, idx): the ids of each list, in order. Rows and not arrays, so that no list has to fit in one task."""
    names = ["gained", "regressed", "unreachable", "reachable_miss"]
    lists = F.array_compact(F.array(*[F.when(F.col(n), n) for n in names]))
    return compared.select(F.explode(lists).alias("list"), "idx").orderBy("list", "idx")


def outcome_matrix(outcomes: DataFrame, models: list[str]) -> DataFrame:
    """model x problem 0/1, and each model's delta against the first."""
    wide = outcomes.groupBy("idx").pivot("model", models).agg(F.max(F.col("solved").cast("int")))
    wide = wide.select("idx", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in models])
    return wide.select("*", *[(F.col(m) - F.col(models[0])).alias(f"{m}_delta") for m in models[1:]])


def subset(rows: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose key is in `include` and not in `exclude`, both tables with that key."""
    if include is not None:
        rows = rows.join(include.select(key).distinct(), key, "left_semi")
    return rows if exclude is None else rows.join(exclude.select(key), key, "left_anti")
