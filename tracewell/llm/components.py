"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import settle

#: Edges (of 16 bytes) that one task contracts by itself instead of by further rounds.
LOCAL_EDGES = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select("v", "m")
    return moved.union(least.select("u", "m")).toDF("a", "b").distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task, at most LOCAL_EDGES, to one edge from each node to the smallest of its component."""
    columns = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if columns:
        ids, ends = np.unique(np.concatenate([np.concatenate(c) for c in zip(*columns)]), return_inverse=True)
        u, v = ends.reshape(2, -1)
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[u], label[v])
            now = label.copy()
            for side in (label[u], label[v], u, v):
                np.minimum.at(now, side, low)
            now = now[now]
            if (now == label).all():
                break
            label = now
        far = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["a", "b"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(a, b) -> (id, component): the smallest id reachable, for every id that has an edge.

    Every step keeps the components and brings nodes nearer to their smallest id; it ends when a
    round changes nothing, or leaves so few edges that one task can contract them. A hub's edges are reduced by partial
    aggregation and by joins that Spark can split; neither edges nor labels ever reach the driver.
    """
    mark = None
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        if seen[0] <= local_edges:
            now = settle(now.coalesce(1).mapInArrow(_contract, "a long, b long"))
            break
        mark, now = seen, settle(_small_star(_large_star(now)))
    roots = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
