"""Paired statistics: exact McNemar, bootstrap intervals, equivalence bounds, ranks, correlations, moments."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.tokens import bound
from tracewell.operators.ordering import materialized

SEED = 20_240_515
#: Rows of a histogram that may be broadcast: some 50 bytes each.
FEW_VALUES = 100_000


def paired(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(idx, by..., solved) of two models -> discordant counts b (only a) and c (only b) over the common problems."""
    both = a.withColumnRenamed("solved", "x").join(b.select("idx", F.col("solved").alias("y")), "idx")
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("x").alias("solved_a"), F.count_if("y").alias("solved_b"), F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(F.col("y") & ~F.col("x")).alias("c"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p: min(1, 2 sum_{i <= min(b, c)} C(n, i) / 2^n), 1 for n = 0.

    Terms are taken relative to the largest, whose logarithm comes from log-gamma, so that no n overflows. They fall by a
    growing ratio from it: those beyond 20 sqrt(n) + 60 are below exp(-800) of it, so the array is as long as the root of the counts.
    """
    n, m = (b + c).cast("double"), F.least(b, c)
    steps = F.when(m > 0, F.sequence(F.lit(1).cast("bigint"), F.least(m, F.ceil(20 * F.sqrt(n)) + 60))).otherwise(F.array().cast("array<bigint>"))
    log_top = log_factorial(n) - log_factorial(m.cast("double")) - log_factorial(n - m) - n * F.log(F.lit(2.0))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(s, k):
        i = m - k + 1  # from C(n, i) to C(n, i - 1)
        term = s["term"] * i / (n - i + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    rest = F.aggregate(steps, zero, down, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * rest * F.exp(log_top)))


def log_factorial(n: Column) -> Column:
    """log n! by Stirling's series from n + 10 on, from which ten factors lead back."""
    x = n + 11.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    back = F.lit(0.0)
    for k in range(1, 11):
        back = back + F.log(n + float(k))
    return series - back


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def uniforms(resamples: list[int], seed: int) -> np.ndarray:
    """Two numbers in (0, 1) for each resample, from the md5 of `seed:resample:0` and `seed:resample:1`: every engine can repeat them."""
    digits = [[hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:13] for j in (0, 1)] for i in resamples]
    return np.array([[(int(d, 16) + 0.5) / 2.0**52 for d in row] for row in digits]).reshape(-1, 2)


def binomial_quantiles(u: np.ndarray, n: int, p: float) -> np.ndarray:
    """For each u the least k with P(X <= k) >= u, X the number of n trials that succeed with probability p.

    Probabilities are taken relative to each other, by the ratios of neighbours, so that no n overflows or loses digits. Those farther
    than 12 deviations and 40 trials from the mean are below what u can tell from 0 or 1; so the work is as the root of n.
    """
    if n == 0 or p <= 0 or p >= 1:
        return np.full(len(u), n if p >= 1 else 0, dtype=np.int64)
    reach = 12 * math.sqrt(n * p * (1 - p)) + 40
    k = np.arange(max(0, int(n * p - reach)), min(n, int(n * p + reach)), dtype=np.float64)
    logs = np.append(0.0, np.cumsum(np.log((n - k) / (k + 1)) + math.log(p / (1 - p))))
    upto = np.cumsum(np.exp(logs - logs.max()))
    return int(k[0]) + np.searchsorted(upto / upto[-1], u)


def resampled_sums(u: np.ndarray, n: int, b: int, c: int) -> np.ndarray:
    """The sum of differences in one resample of n pairs for each row of u. b differences are -1, c are 1, the others 0.

    How many of the drawn pairs differ is a binomial number, and how many of those are 1 another: no pair is drawn.
    """
    differ = binomial_quantiles(u[:, 0], n, (b + c) / n if n else 0.0)
    better = np.zeros(len(u), dtype=np.int64)
    for d in np.unique(differ):
        better[differ == d] = binomial_quantiles(u[differ == d, 1], int(d), c / (b + c) if b + c else 0.0)
    return 2 * better - differ


def bootstrap_sums(counts: DataFrame, iters: int, seed: int = SEED) -> DataFrame:
    """(n, b, c), one row -> (i, total): sums of the differences in each of `iters` resamples of the n pairs."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                n, b, c = (int(df[name].iloc[0]) for name in ("n", "b", "c"))
                yield pd.DataFrame({"i": df["i"], "total": resampled_sums(uniforms(list(df["i"]), seed), n, b, c)})

    spread = counts.sparkSession.range(iters).withColumnRenamed("id", "i")
    return spread.join(F.broadcast(counts.select("n", "b", "c"))).mapInPandas(draw, "i long, total long")  # counts is one row


def clustered_bootstrap_means(clusters: DataFrame, value: str, iters: int, seed: int = SEED) -> DataFrame:
    """(i, mean): the mean of `value` over each of `iters` resamples of the rows (one a cluster).

    How many draws of a resample fall to each stored partition is one multinomial draw, which every task repeats from the same seed; a task then
    draws among its own rows, and only a sum for each resample and task is shuffled.
    """
    stored = materialized(clusters.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x")).withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()}  # a row for each partition
    parts, total = sorted(sizes), sum(sizes.values())
    shares = np.array([sizes[p] / total for p in parts])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [df for df in batches if len(df)]
        if held:
            part, x = int(held[0]["part"].iloc[0]), np.concatenate([df["x"].to_numpy() for df in held])
            at, sums = parts.index(part), np.zeros(iters)
            for i in range(iters):
                mine = np.random.default_rng([seed, i]).multinomial(total, shares)[at]
                sums[i] = x[np.random.default_rng([seed, i, part]).integers(0, len(x), mine)].sum()
            yield pd.DataFrame({"i": np.arange(iters), "sum": sums})

    return stored.select("x", "part").mapInPandas(draw, "i long, sum double").groupBy("i").agg((F.sum("sum") / F.lit(total)).alias("mean"))


def order_statistics(sums: DataFrame, value: str, places: dict[str, int]) -> DataFrame:
    """The values at 0-based places of the sorted column (one row per resample, so their number is `iters`)."""
    ordered = sums.agg(F.array_sort(F.collect_list(value)).alias("a"))
    return ordered.select(*[F.get("a", F.lit(k)).alias(name) for name, k in places.items()])


def grouped_intervals(counts: DataFrame, by: list[str], iters: int, places: dict[str, int], seed: int = SEED) -> DataFrame:
    """(by..., n, b, c) -> with the values at 0-based places of each row's sorted resampled sums. A row's resamples are made, sorted and dropped where it is."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = uniforms(list(range(iters)), seed)
        for df in batches:
            ends = [np.partition(resampled_sums(u, int(n), int(b), int(c)), list(places.values())) for n, b, c in zip(df["n"], df["b"], df["c"])]
            yield df.assign(**{name: [int(e[at]) for e in ends] for name, at in places.items()})

    kept = counts.select(*by)
    return kept.mapInPandas(draw, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{name} long" for name in places]))


def interval_places(iters: int, confidence: float = 0.95) -> tuple[int, int]:
    """Places of the plain interval: int(alpha/2 N) and int((1 - alpha/2) N)."""
    a = (1 - confidence) / 2
    return int(a * iters), int((1 - a) * iters)


def interval_places_minus_one(iters: int, confidence: float) -> tuple[int, int]:
    """Places of the equivalence test's interval, whose upper one is lower by one; in the same floating-point order."""
    a = (1 - confidence) / 2
    return int(a * iters), int((1 - a) * iters) - 1


def equivalence(low: Column, high: Column, margin: float, n: Column) -> list[Column]:
    far = F.greatest(F.abs(low), F.abs(high))
    return [far.alias("bound"), (100.0 * far / n).alias("bound_percent"), F.when((low > -margin) & (high < margin), "equivalent").otherwise("not shown").alias("verdict")]


def ordered_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, _n, _before, _all): how often each distinct value stands in its group, how many rows of the group are smaller, and the group's size.

    The histogram, in which a heavy tie is one row, is range-sorted and stored; running counts inside its partitions and a row for each
    partition and group give the rest, so no task sees a whole group or all values.
    """
    order = [*by, value]
    counts = rows.groupBy(*order).agg(F.count("*").alias("_n")).repartitionByRange(*order).sortWithinPartitions(*order)
    counts = materialized(counts.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_part", *by).agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*by or [F.lit(0)])  # a row for each partition
    parts = parts.select("_part", *by, F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_sum").over(group).alias("_all"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ["_part", *by]]
    found = counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("c").join(_small(parts).alias("s"), same)
    return found.select(*[F.col(f"c.{k}").alias(k) for k in order], "_n", (F.col("_start") + F.col("_before")).alias("_before"), "_all")


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast, if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW_VALUES else df


def average_rank(rows: DataFrame, by: list[str], value: str, name: str, counted: DataFrame | None = None) -> DataFrame:
    """1-based ranks, ties sharing their mean; rows with a null value go. A histogram of few values, each of which may stand in many rows, is broadcast.

    `counted` has the same rows with fewer columns, or before earlier joins, so that counting does not repeat those.
    """
    ranks = ordered_counts(rows if counted is None else counted, by, value).select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(_small(ranks), [*by, value])


def correlation(x: Column, y: Column) -> Column:
    """Pearson over pairs without NaN or null; NaN for fewer than 3 or for a constant side."""
    good = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    a, b = F.when(good, x), F.when(good, y)
    spread = F.coalesce(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return F.when((F.count(F.when(good, 1)) < 3) | (spread == 0), F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(a, b), spread))


def incomplete_beta(x: Column, a: Column, b: Column, rest: Column | None = None) -> Column:
    """The regularised incomplete beta function I_x(a, b) for 0 <= x <= 1 and a, b > 0, by its continued fraction, which is short on the side
    of x where it is used; `rest` is 1 - x, if it is known better than by subtraction."""
    rest = 1.0 - x if rest is None else rest
    low = x < (a + 1.0) / (a + b + 2.0)
    front = F.exp(log_factorial(a + b - 1.0) - log_factorial(a - 1.0) - log_factorial(b - 1.0) + a * F.log(x) + b * F.log(rest))

    def fraction(v: Column) -> Column:
        p, q, z = v["p"], v["q"], v["z"]
        first = 1.0 / (1.0 - (p + q) * z / (p + 1.0))

        def step(s: Column, k: Column) -> Column:
            even = k * (q - k) * z / ((p + 2.0 * k - 1.0) * (p + 2.0 * k))
            odd = -(p + k) * (p + q + k) * z / ((p + 2.0 * k) * (p + 2.0 * k + 1.0))
            half = lambda c, d, n: F.struct((1.0 + n / c).alias("c"), (1.0 / (1.0 + n * d)).alias("d"))
            one = bound(half(s["c"], s["d"], even), lambda h: F.struct(half(h["c"], h["d"], odd).alias("v"), (s["h"] * h["c"] * h["d"]).alias("h")))
            return bound(one, lambda h: F.struct(h["v"]["c"].alias("c"), h["v"]["d"].alias("d"), (h["h"] * h["v"]["c"] * h["v"]["d"]).alias("h")))

        steps = F.sequence(F.lit(1), (F.ceil(5 * F.sqrt(F.greatest(p, q))) + 100).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), lambda s, k: step(s, k.cast("double")), lambda s: s["h"]) / p

    side = F.struct(F.when(low, a).otherwise(b).alias("p"), F.when(low, b).otherwise(a).alias("q"), F.when(low, x).otherwise(rest).alias("z"))
    inner = front * bound(side, fraction)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).when(low, inner).otherwise(1.0 - inner)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs, from the t distribution with n - 2 degrees of freedom: I_(1 - r^2)((n - 2) / 2, 1 / 2). NaN for fewer than 3 pairs or a NaN."""
    clean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    found = incomplete_beta(1.0 - clean * clean, (n - 2.0) / 2.0, F.lit(0.5), clean * clean)
    return F.when(F.isnan(r) | (n < 3), F.lit(float("nan"))).otherwise(found)


def moments(x: Column) -> list[Column]:
    return [F.stddev_pop(x).alias("std"), F.max(F.abs(x)).alias("max_abs"), F.kurtosis(x).alias("excess_kurtosis")]


def outlier_ratio(rows: DataFrame, by: str, value: str, k: float = 4.0) -> DataFrame:
    """Share of values farther than k standard deviations from their group's mean: two aggregations, the groups' moments joined between."""
    stats = rows.groupBy(by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    far = F.abs(F.col(value) - F.col("_m")) > k * F.col("_s")
    return rows.join(stats, by).groupBy(by).agg(F.avg(far.cast("double")).alias("outlier_ratio"))


def nan_mean(x: Column) -> Column:
    return F.avg(F.when(~F.isnan(x), x))


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(by..., name): the true median of each group, averaging the two middles, over values that are neither NaN nor null; a group without any is left out."""
    counts = ordered_counts(rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, value), by, value)
    holds = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_n"))
    at = lambda place: F.min(F.when(holds(place), F.col(value)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return counts.groupBy(*by).agg(((at(low) + at(high)) / 2).alias(name))


def place_percentiles(rows: DataFrame, value: str, places: dict[str, float]) -> DataFrame:
    """For each name, the value at 0-based place floor(n q) of the sorted column: for q = 0.5 the upper median. One row, of nulls for no values.

    Exact, from counts of distinct values in sorted partitions: each of them hands on a row.
    """
    counts = ordered_counts(rows.where(F.col(value).isNotNull()).select(value), [], value)
    place = lambda q: F.least(F.floor(F.col("_all") * q), F.col("_all") - 1)
    return counts.agg(*[F.min(F.when((F.col("_before") <= place(q)) & (place(q) < F.col("_before") + F.col("_n")), F.col(value))).alias(name) for name, q in places.items()])


def means_by(rows: DataFrame, by: str, kinds: list[str], values: list[str], digits: int) -> DataFrame:
    """Count and rounded means of the rows of each listed kind; a kind without rows is left out, and NaN counts as a number."""
    return rows.where(F.col(by).isin(kinds)).groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(v), digits).alias(v) for v in values])
