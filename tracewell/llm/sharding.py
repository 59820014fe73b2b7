"""Sharding along a Hilbert curve over several metadata dimensions.

Documents are quantised in each dimension, sorted by their cell's index on the curve, and the order
is cut into runs of near equal bytes. Neighbours on the curve are neighbours in every dimension, so
a shard spans a small range of each and readers that filter on any of them can skip most shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import settle

#: Tables of one row per distinct value are broadcast up to so many rows, and joined by shuffle beyond.
SMALL_ROWS = 100_000
#: A text that stands in at least this part of the rows is hot: there are at most so many, so they are broadcast.
HOT = 1000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of `cells` (n x dims, values below 2**bits), by bitwise untangling."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            turn = (x[i] & high) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    parity = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        parity = np.where((x[-1] >> b) & 1, parity ^ ((1 << b) - 1), parity)
    x ^= parity
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _cells(rows: DataFrame, name: str, top: int) -> DataFrame:
    """(name, cell): values in order share the cells 1 to top by their number of rows, each at the middle of its own.

    Like the values, the cells are in order, so that the least and greatest value of a shard follow the curve.
    """
    values = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    run = Window.orderBy(name)  # a row for each distinct value
    values = values.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return settle(values.select(name, (1 + F.floor((F.col("upto") - F.col("n") / 2) * top / F.col("all"))).cast("long").alias("cell")))


def _gathered(rows: DataFrame, shards: int) -> DataFrame:
    """rows with the least curve index of their text instead of their own, and `whole`: the bytes of their text's rows, if these are to stay together, else 0.

    A text of more than half a shard is cut by rows. Only texts that stand in several rows are joined back, the hot ones by broadcast.
    """
    same = ["text_hash", "text_crc32", "size"]
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    groups = settle(rows.groupBy(*same).agg(F.count("*").alias("n"), F.min("curve").alias("first")).where("n > 1"))
    hot = F.broadcast(groups.where(F.col("n") * HOT >= n))
    found = rows.join(hot, same).unionByName(rows.join(hot.select(*same), same, "left_anti").join(groups.where(F.col("n") * HOT < n), same, "left"))
    size = F.coalesce("n", F.lit(1)) * F.col("size")
    return found.select("doc_id", *same, F.coalesce("first", "curve").alias("curve"), F.when(size * 2 * shards <= (total or 0), size).otherwise(0).alias("whole"))


def shard(docs: DataFrame, shards: int = 24, bits: int = 8, together: bool = False) -> DataFrame:
    """Assign each row of `docs` (doc_id, text, lang, source; others are ignored) to a shard.

    Law `bytes`: runs of the curve order hold near equal bytes; a boundary falls where the middle of
    a document passes the ideal cut, so a shard misses its share by less than one document at either
    end. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve.
    With `together`, rows of equal text (null as empty) lie where the first of them lies on the curve, and in one shard:
    boundaries fall between texts, so a shard may miss its share by a text with all its copies. Only copies of more than
    half a shard are cut by rows. Copies far from their first one widen what a shard spans, so readers skip less.
    Cells follow the order of the values and share the rows: quantiles of size, and of lang and source by code point.
    Null text has size 8 and the checksum of nothing; null lang or source fall in cell 0; equal texts
    of one cell, repeated rows included, lie next to each other. Fewer rows than shards leave some
    shards empty; an empty table gives no rows.
    """
    top = (1 << bits) - 1
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    text_crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"))
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))) if together else F.lit(0).cast("long")
    rows = settle(docs.select("doc_id", size.alias("size"), text_crc.alias("text_crc32"), text_hash.alias("text_hash"), "lang", "source"))
    bounds = np.array(rows.agg(F.percentile_approx("size", [i / top for i in range(1, top)], 100 * top)).first()[0] or [0])
    for name, cell in (("lang", "a"), ("source", "b")):
        cells = _cells(rows, name, top).withColumnRenamed("cell", cell)
        # A row for each distinct value: small enough to broadcast, or joined by shuffle.
        rows = rows.join(F.broadcast(cells) if cells.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else cells, name, "left").fillna(0, [cell]).drop(name)

    def index(batches: Iterator) -> Iterator:
        for df in batches:
            df["c"] = np.searchsorted(bounds, df["size"].to_numpy())
            df["curve"] = hilbert_index(df[["a", "b", "c"]].to_numpy(np.int64).reshape(-1, 3), bits)
            yield df[["doc_id", "size", "text_crc32", "text_hash", "curve"]]

    rows = rows.mapInPandas(index, "doc_id long, size long, text_crc32 long, text_hash long, curve long")
    rows = _gathered(settle(rows), shards) if together else rows.withColumn("whole", F.lit(0).cast("long"))
    order = ["curve", "text_crc32", "text_hash", "size", "doc_id"]
    rows = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    def running(batches: Iterator) -> Iterator:
        total = n = start = 0  # each task reads one stored, sorted partition
        last = None
        for df in batches:
            if not len(df):
                continue
            sums = df["size"].cumsum() + total
            df["ahead"], df["row"] = sums - df["size"], np.arange(n, n + len(df))
            keys = df[["curve", "text_crc32", "text_hash", "size"]].to_numpy(np.int64)
            new = np.append(last is None or (keys[0] != last).any(), (keys[1:] != keys[:-1]).any(axis=1))
            df["start"] = np.maximum.accumulate(np.where(new, df["ahead"], start))
            total, n, start, last = int(sums.iloc[-1]), n + len(df), int(df["start"].iloc[-1]), keys[-1]
            yield df

    local = rows.mapInPandas(running, "doc_id long, size long, text_crc32 long, text_hash long, curve long, whole long, part int, ahead long, row long, start long")
    text = F.struct("curve", "text_crc32", "text_hash", F.col("size").alias("bytes"))
    parts = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max(text).alias("text"))
    # A row per sorted partition, so their number is that of the shuffle's tasks and not of the documents.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part", "text", "bytes", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    placed = local.withColumn("text", text).join(F.broadcast(parts.drop("text", "bytes")), "part")
    if together:  # a partition's last text may go on in the next ones: its start is that in the first of them
        ends = rows.withColumn("text", text).join(F.broadcast(parts), ["part", "text"]).groupBy("part", "text", "bytes", "bytes_before").agg(F.sum("size").alias("tail"))
        begins = settle(ends.groupBy("text").agg(F.min(F.col("bytes_before") + F.col("bytes") - F.col("tail")).alias("begin")))
        placed = placed.join(F.broadcast(begins), "text", "left")
    else:
        placed = placed.withColumn("begin", F.lit(None).cast("long"))
    ahead = F.when(F.col("whole") == 0, F.col("ahead") + F.col("bytes_before")).otherwise(F.coalesce("begin", F.col("start") + F.col("bytes_before")))
    middle = placed.select("doc_id", "size", "text_crc32", "curve", (F.col("row") + F.col("rows_before")).alias("row"), (2 * ahead + F.when(F.col("whole") == 0, F.col("size")).otherwise(F.col("whole"))).alias("middle"), "total")
    placed = middle.select("doc_id", "size", "text_crc32", "curve", "row", F.expr(f"cast(least({shards - 1}, middle * {shards} div (2 * total)) as int)").alias("shard"))
    starts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write documents as Parquet, a folder for each shard, in curve order within it.

    Rows are matched to their shard by doc_id, size and checksum, of which repeated rows share one.
    """
    placed = shard(docs, shards).select(F.col("doc_id").alias("_d"), F.col("size").alias("_z"), F.col("text_crc32").alias("_c"), F.col("shard").alias("_shard"), "curve")
    placed = placed.groupBy("_d", "_z", "_c").agg(F.min("_shard").alias("_shard"), F.min("curve").alias("_curve"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"))
    out = docs.join(placed, docs["doc_id"].eqNullSafe(placed["_d"]) & (size == placed["_z"]) & (crc == placed["_c"])).drop("_d", "_z", "_c")
    out.repartitionByRange("_shard", "_curve").sortWithinPartitions("_shard", "_curve").drop("_curve").write.partitionBy("_shard").parquet(path)
