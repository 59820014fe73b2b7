"""Approximate nearest neighbours by inner product with cross-polytope hashing.

Vectors are dealt to spaces of one dimension and similar norm, within which the largest inner product is nearly the
smallest angle. Their directions are turned by fast Hadamard pseudo-rotations and hashed to the nearest signed
axis; a table concatenates one or more such hashes, more of them as a space has more rows and its neighbours are nearer.
A query probes the likeliest combinations of axes in every table, and whatever lies there is reranked by the exact inner
product. A few pilot queries, held against all rows, tell how near the k-th neighbours are, and so which hash length and
how many probes a space needs. Whoever belongs among the k nearest scores no less than the k-th one found, which bounds
its angle, and with it the chance that the probes missed it: where that chance is too large, or fewer than k were found,
the query is held against the whole space. Buckets are dealt out in blocks of bounded size on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import settle

TABLES, SEED = 16, 20_240_607
#: Rows of a bucket that meet in one block of the rerank.
BLOCK = 4096
#: Norms of a space lie within this ratio, but for the last one of a dimension, which has all smaller ones.
RATIO, BANDS = 1.25, 8
#: Chance of being probed that anyone who belongs among the k nearest must have.
ASSURED = 0.9
#: Spaces of so few rows are scanned whole: a query probes no fewer buckets.
SMALL = 160
#: Queries of a dimension held against all its rows beforehand, and the share of them that may turn out farther than the probes are made for.
PILOTS, FARTHER = 64, 0.1
#: Rows of a dimension, and bytes of them at most, whose (k + 1)-th best is a floor for every query's results.
SAMPLE, SAMPLE_BYTES = 2048, 16 << 20
#: Tables that are probed first: the k-th best found there is the floor for the others.
FIRST, OTHERS = range(2), range(2, TABLES)
#: Hash lengths and probes a table to choose from, those that find the fewest strangers first.
LADDER = ((4, 1000), (4, 4000), (3, 500), (3, 2000), (2, 100), (2, 200), (2, 300), (2, 600), (1, 10), (1, 16))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, turn: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform."""
    draw = np.random.default_rng(SEED + turn)
    for _ in range(3):
        x = _hadamard(x * draw.choice([-1.0, 1.0], x.shape[1]))
    return x


def axis_scores(x: np.ndarray, table: int, length: int) -> list[np.ndarray]:
    """For each of a table's rotations, the nearness of every signed axis: +e_i at i, -e_i at width + i."""
    turned = [rotate(x, table * 8 + i) for i in range(length)]
    return [np.concatenate([t, -t], axis=1) for t in turned]


def own_bucket(scores: list[np.ndarray]) -> np.ndarray:
    code = np.zeros(len(scores[0]), np.int64)
    for s in scores:
        code = code * s.shape[1] + s.argmax(axis=1)
    return code


def best_buckets(scores: list[np.ndarray], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The `probes` combinations of axes (fewer if there are not as many) of greatest summed nearness, with that sum, best first.

    Of two sorted lists, the places r and c (from 1) can only be among the best if r c <= probes.
    """
    code = value = None
    for s in scores:
        axes = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        near = np.take_along_axis(s, axes, axis=1)
        if code is None:
            code, value = axes.astype(np.int64), near
            continue
        r, c = np.nonzero(np.outer(np.arange(1, value.shape[1] + 1), np.arange(1, near.shape[1] + 1)) <= probes)
        total = value[:, r] + near[:, c]
        top = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        value, code = np.take_along_axis(total, top, axis=1), np.take_along_axis(code[:, r] * s.shape[1] + axes[:, c], top, axis=1)
    return code, value


@lru_cache(maxsize=None)
def assured_cosine(width: int, length: int, probes: int, tables: int = TABLES) -> float:
    """The least cosine, in steps of 0.01, at which the probes meet a vector with a chance of ASSURED, by simulation; -1 if they cover all buckets."""
    if probes >= (2 * width) ** length:
        return -1.0
    draw = np.random.default_rng(SEED)
    x, y = draw.normal(size=(2, 400, length, width))
    x /= np.linalg.norm(x, axis=2)[:, :, None]
    y -= (x * y).sum(axis=2)[:, :, None] * x
    y /= np.linalg.norm(y, axis=2)[:, :, None]
    signed = np.concatenate([x, -x], axis=2)
    _, value = best_buckets([signed[:, i] for i in range(length)], probes)
    for cosine in np.arange(100) / 100:
        turned = cosine * x + np.sqrt(1 - cosine * cosine) * y
        axis = np.concatenate([turned, -turned], axis=2).argmax(axis=2)
        mine = sum(np.take_along_axis(signed[:, i], axis[:, i, None], axis=1)[:, 0] for i in range(length))
        if 1 - (1 - (mine >= value[:, -1] - 1e-12).mean()) ** tables >= ASSURED:
            return float(cosine)
    return 1.0


@dataclass(frozen=True)
class Space:
    """Rows of one dimension and band of norms. Hash length 0: scanned whole."""

    index: int
    rows: int
    top: float
    width: int
    length: int = 0
    probes: int = 0

    def tuned(self, cosine: float) -> Space:
        """With the first entry of LADDER that meets neighbours of this cosine and has more rows than all but one of its rotations have buckets."""
        fit = [(n, p) for n, p in LADDER if n == 1 or (2 * self.width) ** (n - 1) <= self.rows]
        length, probes = next((x for x in fit if assured_cosine(self.width, *x) <= cosine), fit[-1])
        return Space(self.index, self.rows, self.top, self.width, length, min(probes, (2 * self.width) ** length))

    def split(self, code: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of a table's group of buckets, those of one first axis, and the rest of the code."""
        rest = (2 * self.width) ** (self.length - 1)
        return (self.index * TABLES + table) * 2 * self.width + code // rest, code % rest

    @property
    def whole(self) -> int:
        return -1 - self.index


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _on_sphere(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x), width))
    x = x / np.abs(x).max(axis=1)[:, None]
    out[:, : x.shape[1]] = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return out


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows (_, v, ...) of one dimension at a time, with their matrix."""
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy()
        for dim in np.unique(sizes):
            some = batch.take(pa.array(np.flatnonzero(sizes == dim)))
            for at in range(0, some.num_rows, 256):
                yield (few := some.slice(at, 256)), _matrix(few.column(1))


def _places(offsets: np.ndarray, buckets: np.ndarray, subs: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(buckets, pa.int64()), subs], ["bucket", "sub"]))


def _data_places(spaces: dict[int, Space], tables: range):
    """Rows (id, v, space) of hashed spaces -> id, v, and their bucket in each of these tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _by_size(batches):
            index = some.column(2).to_numpy()
            for i in np.unique(index):
                s, mine = spaces[i], np.flatnonzero(index == i)
                sphere = _on_sphere(x[mine], s.width)
                split = [s.split(own_bucket(axis_scores(sphere, t, s.length)), t) for t in tables]
                bucket, sub = (np.stack(c, axis=1).ravel() for c in zip(*split))
                part = some.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _places(np.arange(len(mine) + 1) * len(tables), bucket, pa.array(sub))], ["id", "v", "places"])

    return run


def _query_places(spaces: dict[int, list[Space]], sample, k: int, tables: range):
    """Rows (id, v) -> id, v, a score that the k + 1 best reach, and for each group of buckets that they probe in these tables of spaces of their dimension, the buckets' rests.

    Spaces without hashes go with the first tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _by_size(batches):
            n, found = len(x), [(np.zeros(0, np.int64),) * 3]
            some_rows, floor = sample.value.get(x.shape[1], np.zeros((0, 1))), np.full(n, -np.inf)
            if len(some_rows) > k:
                floor = np.partition(x @ some_rows.T, len(some_rows) - k - 1, axis=1)[:, len(some_rows) - k - 1]
            for s in spaces.get(x.shape[1], []):
                if not s.length:
                    if tables == FIRST:
                        found.append((np.arange(n), np.full(n, s.whole), np.zeros(n, np.int64)))
                    continue
                sphere = _on_sphere(x, s.width)
                for t in tables:
                    code = best_buckets(axis_scores(sphere, t, s.length), s.probes)[0]
                    found.append((np.repeat(np.arange(n), code.shape[1]), *s.split(code.ravel(), t)))
            row, bucket, sub = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((sub, bucket, row))
            row, bucket, sub = row[order], bucket[order], sub[order]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])][: len(row)])
            subs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(sub))
            places = _places(np.searchsorted(row[starts], np.arange(n + 1)), bucket[starts], subs)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(floor), places], ["id", "v", "floor", "places"])

    return run


def _rerank(k: int):
    """The k + 1 best rows (id, v, sub) that each query (id, v, sub, floor) of a block shares a bucket with, unless below its floor."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        a = a.sort_by("sub")
        x, y = _matrix(a["v"].combine_chunks()), _matrix(b["v"].combine_chunks())
        ids, qids, least = a["id"].to_numpy(), b["id"].to_numpy(), b["floor"].to_numpy()
        subs, starts = np.unique(a["sub"].to_numpy(), return_index=True)
        ends, lists = np.append(starts[1:], len(x)), b["sub"].combine_chunks()
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        longest, keep = np.sqrt((x * x).sum(axis=1).max()), min(k + 1, len(x))
        for at in range(0, len(y), 512):
            some, mine = y[at : at + 512], lists.slice(at, 512)
            flat, owner = mine.flatten().to_numpy(), np.repeat(np.arange(len(some)), mine.value_lengths().to_numpy())
            rough = np.full((len(some), len(x)), -np.inf)
            place = np.minimum(np.searchsorted(subs, flat), len(subs) - 1)
            hit = subs[place] == flat
            place, owner = place[hit], owner[hit]
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            for p, q in zip(*np.unique(place, return_index=True)):
                who = owner[q : np.searchsorted(place, p, "right")]
                rough[who, starts[p] : ends[p]] = some[who] @ x[starts[p] : ends[p]].T
            floor = np.maximum(np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep], least[at : at + 512]) - 1e-9 * longest * np.sqrt((some**2).sum(axis=1))
            q, i = np.nonzero((rough >= floor[:, None]) & (rough > -np.inf))
            found.append((qids[at + q], ids[i], (some[q] * x[i]).sum(axis=1)))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names)

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, block: int = BLOCK) -> DataFrame:
    """The k nearest found for each row of `vectors` (vec_id, embedding; others are ignored) whose vec_id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id, score: the inner product of the original vectors in
    double precision, nearest first, ties to the smaller vec_id. Null, empty and zero vectors, and those
    with null or non-finite components, take no part, and neither do rows without vec_id. Vectors of different dimensions
    have no inner product: each dimension is searched by itself (the driver holds a row for each and its bands of norms). Equal
    vectors are searched once: only the k + 1 smallest vec_ids of them can be
    among anyone's k nearest, so the others are set aside without loss. A vec_id that repeats with
    one vector counts once.
    """
    good = (F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    narrow = isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType)
    kind = f"array<{'float' if narrow else 'double'}>"  # what the components are stored as: floats are exact in half the bytes
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("v")).where(good)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double")))
    norm = norm * F.sqrt(F.aggregate(F.transform("v", lambda x: x / norm), F.lit(0.0), lambda a, x: a + x * x))  # neither over- nor underflows
    rows = settle(rows)

    # Equal vectors: partial aggregation keeps the k + 1 smallest ids of each before anything is shuffled.
    hashed = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))

    def smallest(batches: Iterator) -> Iterator:
        for df in batches:  # of a batch, at most k + 1 rows of each vector go on
            df = df.sort_values("vec_id").drop_duplicates(["h1", "h2", "vec_id"])
            yield df[df.groupby(["h1", "h2"]).cumcount() <= k]

    fewer = hashed.mapInPandas(smallest, f"vec_id long, v {kind}, h1 long, h2 long")
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    base = settle(fewer.dropDuplicates(["h1", "h2", "vec_id"]).withColumn("nth", nth).where(F.col("nth") <= k + 1).select("vec_id", "v", "h1", "h2"))
    classes = base.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = settle(classes.select(F.monotonically_increasing_id().alias("id"), "v", "ids", F.size("v").alias("dim"), norm.alias("norm")))
    longest = classes.groupBy("dim").agg(F.max("norm").alias("longest"))
    band = F.least(F.greatest(F.floor(F.log(F.col("longest") / F.col("norm")) / np.log(RATIO)), F.lit(0)), F.lit(BANDS - 1))
    classes = settle(classes.join(F.broadcast(longest), "dim").select("id", "v", "ids", (F.col("dim") * BANDS + band).cast("int").alias("space")))
    found_spaces = classes.select("space", norm.alias("norm")).groupBy("space").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()
    spaces = {r["space"]: Space(r["space"], r["n"], r["top"], 1 << (r["space"] // BANDS - 1).bit_length()) for r in found_spaces}
    large = [i for i, s in spaces.items() if s.rows > SMALL]
    whole = classes.select("id", "v", (-1 - F.col("space")).cast("long").alias("bucket"), F.lit(0).cast("long").alias("sub"))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("id"), "v")

    def meet(data: DataFrame, queries: DataFrame) -> DataFrame:
        """The k + 1 best of each block, (query_id, id, score). Large buckets and busy queries are cut into blocks that meet pairwise."""
        counts = settle(data.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")).join(queries.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("q_cuts")), "bucket"))
        small = F.broadcast(counts)  # a row for each signed axis of each table and space
        data = data.join(small, "bucket").withColumn("cut", F.pmod(F.col("id"), F.col("cuts"))).withColumn("q_cut", F.explode(F.sequence(F.lit(0), F.col("q_cuts") - 1)))
        queries = queries.join(small, "bucket").withColumn("q_cut", F.pmod(F.xxhash64("id"), F.col("q_cuts"))).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        keys = [F.col("bucket"), F.col("cut").cast("int").alias("cut"), F.col("q_cut").cast("int").alias("q_cut")]
        left, right = data.select(*keys, "id", "v", "sub"), queries.select(*keys, "id", "v", "sub", "floor")
        return left.groupBy("bucket", "cut", "q_cut").cogroup(right.groupBy("bucket", "cut", "q_cut")).applyInArrow(_rerank(k), "query_id long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        # The k + 1 best classes of a query hold its k nearest, whichever of them is the query's own.
        found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        return found.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") <= k + 1).drop("place")

    def ranked(found: DataFrame) -> DataFrame:
        each = best(found).join(classes.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
        each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def kth(found: DataFrame) -> DataFrame:
        return ranked(found).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))

    def exploded(queries: DataFrame, spaces: dict[int, Space], tables: range) -> DataFrame:
        by_dim: dict[int, list[Space]] = {}
        for i, s in spaces.items():
            by_dim.setdefault(i // BANDS, []).append(s)
        placed = queries.mapInArrow(_query_places(by_dim, sample, k, tables), f"id long, v {kind}, floor double, places array<struct<bucket: long, sub: array<long>>>")
        return placed.select("id", "v", "floor", F.explode("places").alias("place")).select("id", "v", "floor", "place.*")

    among = F.size("v").isin(sorted({i // BANDS for i in large})) if large else F.lit(False)
    some = classes.where(among).withColumn("n", F.row_number().over(Window.partitionBy(F.size("v")).orderBy(F.xxhash64("id"))))
    of_dim: dict[int, list] = {}
    for r in some.where(F.col("n") <= F.least(F.lit(SAMPLE), F.floor(SAMPLE_BYTES / 8 / F.size("v")))).select("v").collect():
        of_dim.setdefault(len(r["v"]), []).append(r["v"])
    sample = vectors.sparkSession.sparkContext.broadcast({d: np.array(v, np.float64) for d, v in of_dim.items()})
    if large:
        pilots = queries.where(among).withColumn("n", F.row_number().over(Window.partitionBy(F.size("v")).orderBy(F.xxhash64("id"), "id", F.xxhash64("v"))))
        pilots = settle(pilots.where(F.col("n") <= PILOTS).select("id", "v"))
        reach = pilots.join(kth(meet(whole, exploded(pilots, spaces, FIRST))), "id", "left").select(F.size("v").alias("dim"), (F.col("kth") / norm).alias("reach")).collect()  # PILOTS a dimension
        for i in large:
            cosines = sorted(-1.0 if r["reach"] is None else r["reach"] / spaces[i].top for r in reach if r["dim"] == i // BANDS) or [-1.0]
            spaces[i] = spaces[i].tuned(cosines[int(FARTHER * len(cosines))])

    within = F.col("space").isin(large) if large else F.lit(False)

    def placed(tables: range) -> DataFrame:
        data = classes.where(within).select("id", "v", "space").mapInArrow(_data_places(spaces, tables), f"id long, v {kind}, places array<struct<bucket: long, sub: long>>")
        return data.select("id", "v", F.explode("places").alias("place")).select("id", "v", "place.*")

    # Nothing below the k-th best of the first tables can be among the k nearest: the other tables need not hand it on.
    unhashed = whole.where(F.col("bucket").isin([s.whole for s in spaces.values() if not s.length]))
    found = settle(best(meet(placed(FIRST).unionByName(unhashed), settle(exploded(queries, spaces, FIRST)))))
    if large:
        asked = exploded(queries, spaces, OTHERS).join(kth(found), "id", "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth")
        found = settle(best(found.unionByName(meet(placed(OTHERS), settle(asked)))))
    # Queries that lack rows, or may have missed nearer ones in a space, are held against the whole of it.
    reached = queries.join(kth(found), "id", "left").select("id", "v", "kth", norm.alias("norm"), F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
    doubtful = [
        F.when((F.size("v") == i // BANDS) & (F.col("kth").isNull() | (F.col("kth") < assured_cosine(spaces[i].width, spaces[i].length, spaces[i].probes) * spaces[i].top * F.col("norm"))), F.lit(spaces[i].whole))
        for i in large
    ]
    again = reached.select("id", "v", F.explode(F.array_compact(F.array(*doubtful).cast("array<long>"))).alias("bucket"), F.array(F.lit(0).cast("long")).alias("sub"), "floor")
    return ranked(found.unionByName(meet(whole.where(F.col("bucket").isin([spaces[i].whole for i in large])), settle(again))))
