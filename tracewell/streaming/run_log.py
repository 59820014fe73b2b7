"""Run logs as streams: append-only events to a log and a status, counters by difficulty across chunks.

State is keyed by run, or by difficulty, and so is bounded by their number; exactly-once delivery rests on the stream's
checkpoint and on batch numbers, under which a repeated batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell import schemas
from tracewell.sources import sinks


def read_events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.RUN_EVENT + ", run string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.json(folder).where("kind is not null")


def log_and_status(events: DataFrame, log: str, status: str, checkpoint: str) -> StreamingQuery:
    """Each batch is appended to the log, then the latest event of every run becomes a new status version."""
    def both(batch: DataFrame, number: int) -> None:
        sinks.append_events(batch, log, status, number)

    return events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(events: DataFrame) -> DataFrame:
    """Passes and failures by difficulty over all chunks so far, of either generation of the schema (the older one has no difficulties)."""
    chunk = events.where("kind = 'chunk'")
    by = F.coalesce(F.col("by_difficulty"), F.map_from_arrays(F.array(F.lit("?")), F.array(F.struct(F.col("chunk_pass").alias("pass"), F.col("chunk_fail").alias("fail"), F.col("fail_causes").alias("causes")))))
    rows = chunk.select(F.explode(by).alias("difficulty", "c"))
    return rows.groupBy("difficulty").agg(F.sum("c.pass").alias("passed"), F.sum("c.fail").alias("failed"))


def merge_counts(changed: DataFrame, target: str, number: int, key: str = "difficulty") -> None:
    """A new version of a keyed table: the rows of the version before, of which those that changed are replaced. Repeating a batch writes the same version again."""
    before = sinks.version_before(changed.sparkSession, target, number)
    rows = changed
    if before is not None:
        old = changed.sparkSession.read.parquet(f"{target}/v={before}")
        rows = old.join(changed.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti").unionByName(changed)
    sinks.replace_table(rows, target, number)


def durable_counters(events: DataFrame, target: str, checkpoint: str, key: str = "difficulty") -> StreamingQuery:
    """counters() in update mode: a batch hands on the counts that it changed alone, and they become a new version of the table under target.

    The counts are the stream's state and are stored with its checkpoint: after a stop the next start goes on from there. A batch that is run
    again after a failure has the same number, and so replaces its own version.
    """
    write = counters(events).writeStream.outputMode("update").foreachBatch(lambda batch, number: merge_counts(batch, target, number, key))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of a versioned table."""
    return spark.read.parquet(f"{target}/v={sinks.version_before(spark, target, 1 << 62)}")


def windowed_rates(events: DataFrame, start: str = "2000-01-01", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Extra: pass rate by event-time window, with a watermark for late events."""
    at = (F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + F.col("t")).cast("timestamp")
    rows = events.where("kind = 'chunk'").withColumn("at", at).withWatermark("at", late)
    return rows.groupBy(F.window("at", width)).agg(F.sum("chunk_pass").alias("passed"), F.sum("chunk_fail").alias("failed"))
