"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts spell it.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that a Python worker holds at a time.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint.

    The files go to the shared folder in spark.checkpoint.dir, so any executor can read them
    again after another is lost. Only where that setting is missing is a folder chosen here,
    under the warehouse. Whatever runs in Python meanwhile gets its rows in batches of at most BATCH_BYTES.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(_BATCH, before)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and afterwards its memory goes back to the system: Python workers outlive their tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return task


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() gives the same in an all-ASCII text and is much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs (id, text) without the repetitions of rows whose id is in repeated.id; only these are shuffled."""
    marked = maybe_among(docs, "id", repeated)
    return marked.where("not maybe").select("id", "text").unionByName(marked.where("maybe").select("id", "text").distinct())


def maybe_among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df with a column `maybe`: true where df[column] is in ids.id, and seldom elsewhere.

    The ids become a bitmap of hashes with 16 bits for each, of 128 KB to 64 MB whatever their
    number, so that it can be broadcast: it spares most other rows of df a shuffle.
    """
    bits = 1 << min(29, max(20, (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = ids.select(place("id").alias("_p")).groupBy(F.floor(F.col("_p") / 32768).alias("_map")).agg(F.call_function("bitmap_construct_agg", F.col("_p") % 32768).alias("_bits"))
    rows = df.withColumn("_p", place(column)).withColumn("_map", F.floor(F.col("_p") / 32768)).join(F.broadcast(maps), "_map", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast((_p % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col("_p") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("_p", "_map", "_bits")
