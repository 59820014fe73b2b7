"""Sinks: keyed upserts, summaries, event logs with a status snapshot, reports, fingerprinted snapshots."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.curate import monotone_upsert
from tracewell.operators.evaluate import fully_passed
from tracewell.sources.scratch import exists


def replace_table(df: DataFrame, path: str, version: int) -> str:
    """Write a new version beside the old ones and return its path: readers of an older version are not disturbed, and a lost job leaves no half table."""
    target = f"{path}/v={version}"
    df.write.mode("overwrite").parquet(target)
    return target


def upsert(old: DataFrame, new: DataFrame, path: str, version: int, key: str = "idx", passed: str = "passed") -> str:
    """Monotone upsert: a passing row is never replaced by a failing one."""
    return replace_table(monotone_upsert(old, new, key, passed), path, version)


def drop_failed(rows: DataFrame, path: str, version: int) -> str:
    """Predicate delete: only fully passed rows go on to the new version."""
    return replace_table(rows.where(fully_passed(F.col("test_passed"), F.col("test_total"))), path, version)


def truncate(spark: SparkSession, path: str) -> bool:
    """Remove a results folder (a fresh start); False if there was none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def solutions(samples: DataFrame, path: str) -> None:
    """{task_id, solution} lines."""
    json_lines(samples.select("task_id", "solution"), path)


def summary(df: DataFrame, path: str) -> None:
    """One JSON object in one file; a summary is a row per model."""
    df.coalesce(1).write.mode("overwrite").json(path)


def version_before(spark: SparkSession, path: str, version: int) -> int | None:
    """The newest complete version older than `version`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    numbers = [int(f.getPath().getParent().getName()[2:]) for f in found or []]
    return max((n for n in numbers if n < version), default=None)


def append_events(events: DataFrame, log: str, status: str, version: int, run: str = "run", order: tuple[str, ...] = ("t",)) -> None:
    """Append to the log, then write the latest status of each run as a new version, from the version before it and this batch alone.

    Repeating a batch id overwrites its own part and version only.
    """
    from tracewell.operators.telemetry import latest

    spark = events.sparkSession
    events.write.mode("overwrite").parquet(f"{log}/batch={version}")
    rows, before = spark.read.parquet(f"{log}/batch={version}"), version_before(spark, status, version)
    if before is not None:
        rows = rows.unionByName(spark.read.parquet(f"{status}/v={before}"), allowMissingColumns=True)
    latest(rows, run, list(order)).write.mode("overwrite").parquet(f"{status}/v={version}")


def settings_key(settings: dict) -> str:
    """Settings as text: equal for equal settings, whatever the order of their names."""
    return json.dumps(settings, sort_keys=True, default=str)


def put_manifest(spark: SparkSession, path: str, key: str) -> None:
    """Say of a finished result what made it. It is written last, so a result without one is unfinished."""
    spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").parquet(path)


def manifest(spark: SparkSession, path: str) -> str | None:
    return spark.read.parquet(path).first()["key"] if exists(spark, f"{path}/_SUCCESS") else None


def kept(spark: SparkSession, path: str, key: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The result under path if it was made under the same key, else built anew; and whether it was built.

    Results of different keys lie beside each other, each with its manifest, so a reader of an older one is not disturbed.
    """
    target = f"{path}/{hashlib.sha256(key.encode()).hexdigest()[:16]}"
    made = manifest(spark, f"{target}-manifest") != key
    if made:
        build().write.mode("overwrite").parquet(target)
        put_manifest(spark, f"{target}-manifest", key)
    return spark.read.parquet(target), made


def grid_part(work: Callable[[DataFrame], DataFrame], cells: DataFrame, partial: str, number: int, key: str) -> None:
    """One part of a grid's results, and then the settings that made it."""
    spark = cells.sparkSession
    truncate(spark, f"{partial}/settings/{number}")
    work(cells).write.mode("overwrite").parquet(f"{partial}/results/part={number}")
    put_manifest(spark, f"{partial}/settings/{number}", key)


def grid_results(grid: DataFrame, part: Column, work: Callable[[DataFrame], DataFrame], partial: str, target: str, parts: int, settings: dict) -> DataFrame:
    """Results of every cell of a grid, in parts by the number in `part`. Each is stored when done, with the settings that made it, so a run after an interruption
    works on the parts alone that are missing or were made under other settings; the partial table goes once the whole is written."""
    spark, key = grid.sparkSession, settings_key(settings)
    for number in range(parts):
        if manifest(spark, f"{partial}/settings/{number}") != key:
            grid_part(work, grid.where(part == number), partial, number, key)
    spark.read.option("basePath", f"{partial}/results").parquet(f"{partial}/results/part=*").drop("part").write.mode("overwrite").parquet(target)
    truncate(spark, partial)
    return spark.read.parquet(target)


def snapshot(df: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """Materialize df under its inputs' fingerprint, or read what an earlier run left under the same."""
    target = f"{path}/{fingerprint}"
    if not exists(df.sparkSession, f"{target}/_SUCCESS"):
        df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)


def sources_fingerprint(spark: SparkSession, folders: list[str], ids: DataFrame | None = None) -> str:
    """A fingerprint of all files below the folders (path, time of change, length; only the listing is read) and of a list of ids (its first column, in any order).

    Each is a count and two sums of hashes, which partial aggregation makes without moving a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select("path", "modificationTime", "length")

    def marks(rows: DataFrame) -> str:
        sums = [F.sum(F.xxhash64(F.lit(seed), *rows.columns).cast("decimal(38,0)")) for seed in (1, 2)]
        return ":".join(map(str, rows.agg(F.count("*"), *sums).first()))

    return f"{marks(files)}/{marks(ids.select(ids.columns[0])) if ids is not None else ''}"


def fresh_snapshot(spark: SparkSession, path: str, folders: list[str], build: Callable[[], DataFrame], ids: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """A snapshot that is made anew when any of its source files, or its list of ids, is not as it was; and whether it was made now. The fingerprint is taken before the
    sources are read, so one that changes meanwhile makes the snapshot stale."""
    return kept(spark, path, sources_fingerprint(spark, folders, ids), build)


def failure_report(problems: DataFrame, failures: DataFrame, fails: int = 3, code: int = 4000, error: int = 300) -> DataFrame:
    """A Markdown section per problem: header, clipped code, the first failures with collapsed, clipped errors."""
    text = F.substring(F.trim(F.regexp_replace("error", r"\s+", " ")), 1, error)
    lines = failures.where(F.col("nth") <= fails).groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("- "), "category", F.lit(": "), text).alias("line")))).alias("l"))
    rows = problems.join(lines, "idx", "left")
    body = F.concat_ws("\n", F.concat(F.lit("## Problem "), F.col("idx").cast("string")), F.lit("```python"), F.substring("code", 1, code), F.lit("```"), F.array_join(F.col("l.line"), "\n"))
    return rows.select("idx", body.alias("section"))


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Rows as lines of fixed-width text: negative widths pad on the right."""
    cells = [F.rpad(F.col(c).cast("string"), -w, " ") if w < 0 else F.lpad(F.col(c).cast("string"), w, " ") for c, w in widths.items()]
    return df.select(F.concat_ws(" ", *cells).alias("line"))
