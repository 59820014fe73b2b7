"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (the frequent-items sketch behind Spark's approx_top_k) over the digests
names every digest that can hold more than a 1/`HEAVY`th of the rows. Their true counts are then
taken by one exact aggregation, the verified winners (at most `HEAVY`) are broadcast, and their
rows are settled map-side; all other digests go through an ordinary shuffle: an aggregation with partial
results, and a join of its repeated groups, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import SPACE, settle

#: A digest with more than one row in so many is heavy. The summary tracks 16 times as many.
HEAVY = 256


def heavy_digests(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Digests with more than a 1/heavy-th of `rows`, with exact row count and first row; at most `heavy`."""
    tracked, total = 16 * heavy, rows.count()
    # Summaries of single tasks are merged in 64 groups first, so that none merges those of all tasks.
    summary = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("g")).agg(F.expr(f"approx_top_k_accumulate(digest_key, {tracked})").alias("s"))
    # Grouped, because merging the summaries of a task without any fails.
    found = summary.groupBy(F.floor(F.col("g") / 64).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {tracked // 4})").alias("top"))
    found = found.select(F.explode("top").alias("x")).where(F.col("x.count") * heavy >= total).select(F.col("x.item").alias("digest_key"))
    exact = rows.join(F.broadcast(found), "digest_key").groupBy("text_sha256").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid")).alias("first"))
    return exact.where(F.col("n") * heavy > total)


def exact_dedup(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Decide for each row of `docs` (doc_id, text; others are ignored) whether it stays.

    Texts are equal if identical after each run of ASCII white space becomes one space; null counts
    as empty. Of equal texts the row with the smallest doc_id stays (null doc_id first; of repeated
    rows exactly one). Returns doc_id, keep_id, group_size, kept, text_sha256 for every row.
    """
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    rows = settle(docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256")).select("doc_id", "text_sha256", F.xxhash64("text_sha256").alias("digest_key"), F.monotonically_increasing_id().alias("rid")))
    hot = settle(heavy_digests(rows, heavy)).select("text_sha256", F.col("n").alias("hot_n"), F.col("first").alias("hot_first"))
    marked = rows.join(F.broadcast(hot), "text_sha256", "left")
    result = lambda df: df.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")
    cold = marked.where("hot_n is null").select("doc_id", "text_sha256", "rid")
    groups = cold.groupBy("text_sha256").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid")).alias("first")).where("n > 1")
    cold = cold.join(groups, "text_sha256", "left").withColumn("first", F.when(F.col("n").isNull(), F.struct("doc_id", "rid")).otherwise(F.col("first"))).fillna(1, ["n"])
    return result(marked.where("hot_n is not null").withColumnsRenamed({"hot_n": "n", "hot_first": "first"})).unionByName(result(cold))
