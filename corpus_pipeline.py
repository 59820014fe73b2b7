"""A corpus pipeline in five stages, each one operator applied to all that the stage before has kept.

A stage takes (spark, docs, sf_dir) and returns the documents, with their columns, after its decisions;
the last returns the packed pieces. Rows that repeat a doc_id come out of the mixing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import line_dedup, mixing, near_dedup, packing, quality
from tracewell.llm.common import table
from tracewell.llm.queries import word_bpe


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject; it learns from labels outside the held-out fifth. Null and empty texts are scored like any other, and rows that repeat share a score. An empty table gives an empty one."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of whole lines, of at least 50 words, that also stand earlier. Documents of which nothing remains go; null and empty texts stay as they are. An empty table gives an empty one."""
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts all rows of the document with the smallest doc_id. Texts without words are linked with nothing and stay, as do rows without a doc_id. An empty table gives an empty one."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for, so doc_ids may repeat from here on. A null source is a source of its own; a text without words brings no source nearer and is taken by its rate. An empty table gives an empty one."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces in sequences of at most 4096 tokens; a null or empty text is the end token alone. An empty table gives an empty one."""
    return packing.pack(docs, word_bpe())


STAGES = [
    ("quality", keep_good),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the suffix array; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
