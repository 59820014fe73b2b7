"""Near-duplicate detection with b-bit MinHash.

A document's set is its distinct word shingles. Equal sets are one class from the start, so copies
cost nothing further. Bands of full minima propose candidates; what is kept of the minima are their
low bits, packed into longs, and equal-field counts of two signatures, corrected for accidental
collisions, estimate the similarity of a candidate. A bitmap of the set bounds it from above, without
error: the sets differ in at least as many shingles as their bitmaps in bits. What may reach the threshold is confirmed on the full sets.

Links only matter through the components that they form. A band's bucket is therefore first compared with one
member alone, the one that meets most others in its buckets and so tends to be the middle of a group: each class with
its likeliest such partner and then the rest. Only members that are still in different components afterwards
are compared with each other, inside the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import maybe_among, once, released, settle
from tracewell.llm.components import components

SHINGLE, PERCENT = 5, 75
#: 32 bands of 4 minima miss a pair of similarity 0.75 once in 190,000; low bits kept of each minimum.
BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
LONGS = MINIMA * BITS // 64
#: Standard errors that an estimate may fall short of the threshold before a candidate is dropped.
MARGIN = 5.0
#: Bits of a set's bitmap. Large sets fill it, and it then rules out nothing.
BITMAP = 2048
CACHED_WORDS = 300_000

_words: dict[bytes, int] = {}
_draw = np.random.default_rng(20_240_601)
_A = (_draw.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << 1) | 1
_B = _draw.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > CACHED_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        y = x[None, at : at + 2048] * _A[:, None] + _B[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(best, y.min(axis=1), out=best)
    return best


def pack_bits(best: np.ndarray) -> np.ndarray:
    """Low bits of minima (n x MINIMA), packed into longs."""
    fields = (best & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(best), LONGS, 64 // BITS)
    return np.bitwise_or.reduce(fields << np.arange(0, 64, BITS, dtype=np.uint64), axis=2).view(np.int64)


def band_keys(best: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(best), axis=0)
    parts = best.astype(np.uint64).reshape(len(best), BANDS, ROWS)
    for i in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h.view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP, np.uint8)
    bits[(hashes % np.uint64(BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _signed(batches)
    _words.clear()  # Python workers outlive their tasks


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            sizes, digests, best, bits = [], [], np.zeros((some.num_rows, MINIMA), np.uint32), np.zeros((some.num_rows, BITMAP // 64), np.int64)
            for i, text in enumerate(some.column(1)):
                h = shingles(text.as_py())
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                best[i], bits[i] = minima(h), bitmap(h)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            fixed = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(m).ravel()))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), fixed(pack_bits(best)), fixed(bits), fixed(band_keys(best))],
                ["doc_id", "n", "d1", "d2", "sig", "bits", "bands"],
            )


def _plausible(a: str, b: str, percent: int) -> Column:
    """The collision-corrected estimate, unless it or the bitmaps' bound rules the pair out."""
    same = F.lit(MINIMA)
    fields = sum(1 << i for i in range(0, 64, BITS))
    for i in range(LONGS):
        x = F.col(f"{a}.sig")[i].bitwiseXOR(F.col(f"{b}.sig")[i])
        for s in range(BITS.bit_length() - 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1 << s))
        same = same - F.bit_count(x.bitwiseAND(F.lit(fields)))
    chance, t = 2.0**-BITS, percent / 100
    expected = t + (1 - t) * chance
    error = (expected * (1 - expected) / MINIMA) ** 0.5 / (1 - chance)
    estimate = (same / MINIMA - chance) / (1 - chance)
    both, differ = F.col(f"{a}.n") + F.col(f"{b}.n"), F.lit(0)
    for i in range(BITMAP // 64):
        differ = differ + F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i]))
    # The intersection is at most (both - differ) / 2.
    return F.when((estimate >= t - MARGIN * error) & ((100 + percent) * (both - differ) >= 2 * percent * both), estimate)


def verify(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of ids, each listed once, whose full sets reach the threshold; docs has (id, text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def full(text: str) -> np.ndarray:
            if text not in known:
                if len(known) >= 64:
                    known.clear()
                known[text] = shingles(text)
            return known[text]

        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = full(x.as_py() or ""), full(y.as_py() or "")
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if shared and 100 * shared >= percent * (len(p) + len(q) - shared):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
        _words.clear()

    texts = maybe_among(docs, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()).where("maybe").select("id", "text")
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(released(check), "a long, b long")


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components of near-duplicates among the rows of `docs` (doc_id, text; others are ignored).

    Words are runs of non-white-space with A-Z lower-cased. Returns doc_id, n_shingles,
    component_id, kept, one row per row of docs. Null, empty and blank texts have no set and link
    with nothing: they are kept, as are rows of null doc_id, which stay out of the search. Rows that repeat a doc_id
    count as one document: they share its links.
    """
    rows = settle(docs.select("doc_id", "text").mapInArrow(released(_signatures), "doc_id long, n long, d1 long, d2 long, sig array<long>, bits array<long>, bands array<long>"))
    real = rows.where("n > 0 and doc_id is not null")
    classes = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    # Repeated rows are one node, and their text is read once.
    nodes = settle(real.withColumnRenamed("doc_id", "rep").join(classes, ["d1", "d2", "rep"]).dropDuplicates(["d1", "d2", "rep"]).select("rep", "n", "sig", "bits", "bands"))
    repeated = settle(real.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")))
    texts = once(docs.select(F.col("doc_id").alias("id"), "text"), repeated)
    sigs = nodes.select("rep", F.struct("n", "sig", "bits").alias("s"))
    placed = nodes.select("rep", F.explode("bands").alias("key"))
    buckets = placed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("met")).where("low < high").select("key", "met")
    shared = settle(placed.join(buckets, "key").select("key", "rep", "met"))
    known = shared.groupBy("rep").agg(F.sum("met").alias("met"))
    middle = shared.select("key", "rep").join(known, "rep").groupBy("key").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("pivot"))
    members = settle(shared.join(middle, "key").select("key", "rep", "pivot"))

    def estimated(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sigs.withColumnsRenamed({"rep": "a", "s": "p"}), "a").join(sigs.withColumnsRenamed({"rep": "b", "s": "q"}), "b")
        return both.select("a", "b", _plausible("p", "q", percent).alias("estimate")).where("estimate is not null")

    star = settle(estimated(members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()))
    first = star.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    links = settle(verify(settle(first), texts, percent))
    found = settle(components(links))

    def crossing(pairs: DataFrame) -> DataFrame:
        ours, theirs = (found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in")) for c in "ab")
        joined = pairs.join(ours, "a", "left").join(theirs, "b", "left")
        return joined.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")

    second = settle(crossing(star.select("a", "b")).join(first, ["a", "b"], "left_anti"))
    if second.limit(1).count():
        links = settle(links.union(verify(second, texts, percent)))
        found = settle(components(links))

    # What shares a bucket, is in different components, and was not compared with the bucket's first.
    inside = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = inside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_ = settle(inside.join(split, "key").where("rep <> pivot").join(sigs, "rep").select("key", "rep", "component", F.col("s.n").alias("n"), F.col("s.sig").alias("sig"), F.col("s.bits").alias("bits"), F.floor(F.log(F.col("s.n")) / math.log(100 / percent)).alias("sizes")))
    # The smaller set of a link has at least percent of the larger one's shingles, so their classes of size are the same or next to each other.
    a = open_.withColumn("sizes", F.explode(F.array(F.col("sizes") - 1, F.col("sizes"), F.col("sizes") + 1))).alias("p")
    b = open_.alias("q")
    pairs = a.join(b, (F.col("p.key") == F.col("q.key")) & (F.col("p.sizes") == F.col("q.sizes")) & (F.col("p.rep") < F.col("q.rep")) & (F.col("p.component") != F.col("q.component")) & _plausible("p", "q", percent).isNotNull())
    third = settle(pairs.select(F.col("q.rep").alias("a"), F.col("p.rep").alias("b")).distinct())
    if third.limit(1).count():
        links = settle(links.union(verify(third, texts, percent)))
        found = settle(components(links))

    of_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    # A doc_id that rows of several classes share belongs to the component of any of them.
    linked = real.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, of which near_dedup() keeps the document."""
    gone = settle(near_dedup(docs, percent).where("not kept").select(F.col("doc_id").alias("id")).distinct())
    marked = maybe_among(docs.select(F.struct("*").alias("row"), "doc_id"), "doc_id", gone)
    doubtful = marked.where("maybe").join(gone, F.col("doc_id") == F.col("id"), "left_anti")
    return marked.where("not maybe").select("row.*").unionByName(doubtful.select("row.*"))
