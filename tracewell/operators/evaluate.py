"""Evaluation analytics: folds of samples into problems, pass@k, failure taxonomies, retries.

A sample table has idx (problem), j (sample, from 0), passed and total (tests), solved, category.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.scratch import exists

OTHER = "unknown"
#: The order in which difficulties are reported; others follow by name.
DIFFICULTIES = ("easy", "medium", "hard")


def fully_passed(passed: Column, total: Column) -> Column:
    """Zero or unknown tests are no pass."""
    return F.coalesce((total > 0) & (passed == total), F.lit(False))


def ratio(x: Column, n: Column) -> Column:
    """x / max(n, 1)."""
    return x / F.greatest(n, F.lit(1)).cast("double")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k of c successes in n samples: 1 - C(n-c, k) / C(n, k), whose k factors are plain arithmetic; 1 if fewer than k samples fail."""
    missed = F.lit(1.0)
    for i in range(k):
        missed = missed * ((n - c - i) / F.greatest(n - i, F.lit(1)))
    return F.when(n - c < k, 1.0).otherwise(1 - missed)


def fold_samples(samples: DataFrame) -> DataFrame:
    """Samples to problems: counts, whether any solved it, tests of the first sample. One shuffle, partial aggregation before it."""
    return samples.groupBy("idx").agg(
        F.count("*").alias("num_samples"), F.count_if("solved").alias("num_passing"), F.bool_or("solved").alias("solved"),
        F.min_by("passed", "j").alias("passed"), F.min_by("total", "j").alias("total"), F.min_by("category", "j").alias("category"),
    )


def difficulty_rank(d: Column) -> Column:
    out = F.lit(len(DIFFICULTIES))
    for i, name in enumerate(DIFFICULTIES):
        out = F.when(d == name, i).otherwise(out)
    return out


def normal_difficulty(d: Column) -> Column:
    d = F.lower(F.trim(F.coalesce(d, F.lit(""))))
    return F.when(d == "", OTHER).otherwise(d)


def by_difficulty(problems: DataFrame, k: int) -> DataFrame:
    """Problems with difficulty -> rates by difficulty."""
    rows = problems.withColumn("difficulty", normal_difficulty(F.col("difficulty")))
    return rows.groupBy("difficulty").agg(
        F.count("*").alias("num_problems"), ratio(F.sum("passed"), F.sum("total")).alias("test_pass_rate"), F.count_if("solved").alias("solved"),
        F.avg(pass_at_k(F.col("num_samples"), F.col("num_passing"), 1)).alias("pass_at_1"), F.avg(pass_at_k(F.col("num_samples"), F.col("num_passing"), k)).alias("pass_at_k"),
    )


def failure_counts(rows: DataFrame, category: str, categories: list[str]) -> DataFrame:
    """Counts of fixed categories, zeros kept, others ignored. The category list is a literal, so nothing is shuffled but one row a task."""
    counts = rows.agg(*[F.count_if(F.col(category) == c).alias(c) for c in categories])
    return counts.select(F.stack(F.lit(len(categories)), *[x for c in categories for x in (F.lit(c), F.col(c))]).alias("category", "n"))


def dominant(rows: DataFrame, key: str, value: str, position: str, default: str) -> DataFrame:
    """The most frequent value for each key, ties to the one that came first; null values do not count."""
    counts = rows.groupBy(key, value).agg(F.count(value).alias("n"), F.min(position).alias("first"))
    best = counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))
    return best.select(key, F.coalesce(F.when(F.col("n") > 0, F.col(value)), F.lit(default)).alias(value), "n")


def first_success(samples: DataFrame) -> DataFrame:
    """The first sample of each problem that solved it."""
    return samples.where("solved").groupBy("idx").agg(F.min("j").alias("j"))


def best_candidate(samples: DataFrame) -> DataFrame:
    """The sample with most passed tests, the first on ties, and whether it beats sample 0 strictly."""
    best = samples.groupBy("idx").agg(F.max_by(F.struct("j", "passed"), F.struct("passed", -F.col("j"))).alias("b"), F.min_by("passed", "j").alias("score"))
    return best.select("idx", F.col("b.j").alias("j"), F.col("b.passed").alias("passed"), (F.col("b.passed") > F.col("score")).alias("replaces"))


def retry_rounds(samples: DataFrame) -> DataFrame:
    """Attempts that a retry loop would make: all up to the first success, for each round how many and how many new solutions."""
    won = first_success(samples).withColumnRenamed("j", "won")
    tried = samples.join(won, "idx", "left").where(F.col("won").isNull() | (F.col("j") <= F.col("won")))
    return tried.groupBy(F.col("j").alias("round")).agg(F.count("*").alias("attempts"), F.count_if(F.col("j") == F.col("won")).alias("newly_solved"))


def abort_after(rows: DataFrame, key: str, order: list[str], bad: Column, streak: int) -> DataFrame:
    """Mark rows that come after `streak` bad ones in a row within their key (gaps and islands)."""
    window = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.when(bad, 0).otherwise(1)).over(window.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_bad", bad).withColumn("_run", run)
    island = Window.partitionBy(key, "_run").orderBy(*order)
    rows = rows.withColumn("_streak", F.sum(F.col("_bad").cast("int")).over(island.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max("_streak").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("aborted", F.coalesce(before >= streak, F.lit(False))).drop("_bad", "_run", "_streak")


def distinct_failures(rows: DataFrame, key: str, category: str, error: str, position: str, keep: int, clip: int = 160) -> DataFrame:
    """The first `keep` failures of each key that differ in category or clipped error, in order."""
    rows = rows.withColumn("_e", F.substring(F.trim(F.regexp_replace(F.coalesce(error, F.lit("")), r"\s+", " ")), 1, clip))
    firsts = rows.groupBy(key, category, "_e").agg(F.min(position).alias(position))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(position, category, "_e"))
    return firsts.withColumn("nth", nth).where(F.col("nth") <= keep).select(key, "nth", category, F.col("_e").alias("error"))


def diagnose(samples: DataFrame, truncated: Column | None = None, code: Column | None = None) -> DataFrame:
    """Per problem: the most common cause over its unsolved samples, alphabetical on ties, null if there is none.

    Each unsolved sample counts its category once, unless that is null or empty, and the cause `truncated` if it was cut off; truncated samples are counted whether solved or not.
    With `code`, code_length is that of the first unsolved sample, or of the first.
    """
    cut = F.lit(False) if truncated is None else F.coalesce(truncated, F.lit(False))
    rows = samples.withColumn("_cut", cut)
    causes = F.array_distinct(F.array_compact(F.array(F.nullif("category", F.lit("")), F.when(F.col("_cut"), "truncated"))))
    counts = rows.where("not solved").select("idx", F.explode(causes).alias("cause")).groupBy("idx", "cause").agg(F.count("*").alias("n"))
    most = F.struct(-F.col("n"), "cause")
    cause = counts.groupBy("idx").agg(F.min_by("cause", most).alias("cause"))
    length = [] if code is None else [F.min_by(F.length(code), F.struct("solved", "j")).alias("code_length")]
    heads = rows.groupBy("idx").agg(F.bool_or("solved").alias("solved"), F.count_if(~F.col("solved")).alias("unsolved"), F.count_if("_cut").alias("truncated"), *length)
    return heads.join(cause, "idx", "left")


def representative(samples: DataFrame, truncated: Column | None = None) -> DataFrame:
    """The first unsolved sample of each problem, or its first; with `truncated`, whether any sample was cut off."""
    note = [] if truncated is None else [F.bool_or(F.coalesce(truncated, F.lit(False))).alias("any_truncated")]
    rows = samples.groupBy("idx").agg(F.min_by(F.struct("j", "category", "solved"), F.struct("solved", "j")).alias("s"), *note)
    return rows.select("idx", "s.j", "s.category", "s.solved", *(["any_truncated"] if note else []))


def recovery(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """(idx, by, solved) of two passes: how many failures the second recovered, by group, with integer percent."""
    both = before.where("not solved").join(after.select("idx", F.col("solved").alias("now")), "idx", "left")
    got = F.count_if(F.coalesce(F.col("now"), F.lit(False)))
    return both.groupBy(by).agg(F.count("*").alias("failed"), got.alias("recovered")).withColumn("percent", F.expr("recovered * 100 div failed"))


def recovery_totals(before: DataFrame, after: DataFrame, by: str, chunk: str) -> DataFrame:
    """Recovered and still failing by chunk and group, and their totals so far within the group: a window over counts, not over rows."""
    both = before.where("not solved").join(after.select("idx", F.col("solved").alias("now")), "idx", "left").withColumn("now", F.coalesce("now", F.lit(False)))
    counts = both.groupBy(chunk, by).agg(F.count_if("now").alias("recovered"), F.count_if(~F.col("now")).alias("failing"))
    upto = Window.partitionBy(by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({"total_recovered": F.sum("recovered").over(upto), "total_failing": F.sum("failing").over(upto)})


def retry_once(rows: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """attempt(rows, 0) adds a boolean ok; what fails goes through attempt(rows, 1). Adds attempts and dead.

    An attempt leaves a row as it was where it fails, so rows that fail twice come out as they went in, as dead letters.
    `store` keeps the first results, so that a lost executor does not let a retried row be attempted anew.
    """
    first = store(attempt(rows, 0).withColumn("ok", F.coalesce("ok", F.lit(False))))
    again = attempt(first.where("not ok").select(*rows.columns), 1)
    done = first.where("ok").drop("ok").withColumns({"attempts": F.lit(1), "dead": F.lit(False)})
    return done.unionByName(again.withColumns({"attempts": F.lit(2), "dead": ~F.coalesce("ok", F.lit(False))}).drop("ok"))


def recover(failed: DataFrame, stages: list[tuple[str, int, Callable[[DataFrame, int], DataFrame]]], folder: str) -> DataFrame:
    """Failed problems (idx, ...) through stages one after another: (idx, stage, attempt, solved), the first pass of each or its last attempt.

    A stage is a name, a number of attempts and a function (problems, attempt) -> (idx, solved). What an attempt does not solve is the frontier of the next, of the
    same stage or of the one after it. Each attempt's outcome is stored under `folder` before the next begins, so a run that was stopped goes on with
    the attempt in which it was, and what was solved is never tried again. A problem without an outcome, or with a null one, is not solved.
    """
    spark = failed.sparkSession
    frontier, done, last = failed, [], None
    for name, attempts, work in stages:
        for attempt in range(1, attempts + 1):
            path = f"{folder}/{len(done):03d}-{name}-{attempt}"
            if not exists(spark, f"{path}/_SUCCESS"):
                tried = work(frontier, attempt).groupBy("idx").agg(F.bool_or("solved").alias("solved"))
                rows = frontier.select("idx").join(tried, "idx", "left").select("idx", F.lit(name).alias("stage"), F.lit(attempt).alias("attempt"), F.coalesce("solved", F.lit(False)).alias("solved"))
                rows.write.mode("overwrite").parquet(path)
            last = spark.read.parquet(path)
            done.append(last.where("solved"))
            frontier = failed.join(last.where("not solved").select("idx"), "idx", "left_semi")
    return functools.reduce(DataFrame.unionByName, [*done, last.where("not solved")])


def retention(scores: DataFrame, base: Column, reduced: Column) -> DataFrame:
    """What is left of a score after a reduction: gap, ratio and percent; ratio and percent are null where the base is 0."""
    share = reduced / F.nullif(base, F.lit(0).cast("double"))
    return scores.select("*", (reduced - base).alias("gap"), share.alias("ratio"), (100 * share).alias("retention"))
