"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and `CAP` copies. Among all rates whose expected words meet every
source's target, those of least relative entropy to one copy each are r = CAP * sigmoid(theta + lambda z): their odds are tilted
exponentially by the document's words z, with one multiplier lambda for each source's word
constraint. The multipliers solve a convex dual, whose gradient and curvature are sums over the
documents; Newton's steps take these from one distributed aggregation each, over a histogram of sizes.
Rates become whole copies by a rounding that hashes the doc_id, and the rounding's error in each
source is then worked off by adding or removing single copies in hashed order, until no document is small enough
to bring the source nearer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import NOT_SPACE, settle

#: No document is taken more often, so no source can exceed as many times its size.
CAP = 3
#: sigmoid(THETA) = 1 / CAP: without a tilt every document is taken once.
THETA = -math.log(CAP - 1)
WEIGHTS = (1, 2, 3)
#: Newton's steps, or halvings where these fail, before it is an error that the constraints are not met to TOLERANCE.
STEPS, TOLERANCE, BINS = 200, 1e-7, 4096
#: A source this near to its target, as a share of it, is not repaired further.
NEAR = 1e-5
#: Hashes have so many values; a repair that finds its first bin too full looks at it alone, BINS times as finely.
HASHES = 1 << 36
#: Tables of one row per source are broadcast up to so many rows, and joined by shuffle beyond.
SMALL_ROWS = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(k, source, source_size) -> with target: shares by weight of all words, at most CAP sizes.

    Sources that stop at their cap are a prefix in the order of size per weight. The excess of
    a prefix is reshared by weight, so the least prefix after which nothing exceeds its cap is the fixed point.
    The window holds a row for each source, not for each document.
    """
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = sources.withColumn("w", w.cast("double")).withColumn("ratio", CAP * F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = rest / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("stop", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    found = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything)
    return leveled.withColumn("found", found).select("k", "source", "source_size", F.least(CAP * F.col("source_size").cast("double"), F.coalesce(F.col("found") * F.col("w"), F.lit(math.inf))).alias("target"))


def _rate(lam: Column, z: Column, full: Column) -> Column:
    return F.when(full, F.lit(float(CAP))).otherwise(CAP / (1 + F.exp(-(THETA + lam * z))))


def balance(histogram: DataFrame, params: DataFrame, near) -> DataFrame:
    """Newton's iterations for the dual; params: k, target, scale, full -> and lam."""
    state = settle(params.select("*", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(math.inf).alias("miss")))
    for _ in range(STEPS):
        z, r = F.col("size") / F.col("scale"), F.col("r")
        sums = (
            histogram.join(near(state), "k").where("not full").withColumn("r", _rate(F.col("lam"), z, F.lit(False)))
            .groupBy("k").agg(F.sum(F.col("n") * F.col("size") * r).alias("f"), F.sum(F.col("n") * F.col("size") * r * (1 - r / CAP) * z).alias("g"))
        )
        step = state.join(near(sums), "k", "left").withColumn("d", F.coalesce(F.col("f") - F.col("target"), F.lit(0.0)))
        step = step.withColumn("lo", F.when(F.col("d") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("d") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.col("d") / F.col("g")
        safe = F.when((F.col("g") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        lam = F.when(F.col("d") == 0, F.col("lam")).otherwise(safe)
        state = settle(step.select("k", "source", "source_size", "target", "scale", "full", lam.alias("lam"), "lo", "hi", (F.abs("d") / F.greatest(F.col("target"), F.lit(1.0))).alias("miss")))
        if (state.agg(F.max("miss")).first()[0] or 0) < TOLERANCE:
            return state.drop("lo", "hi", "miss")
    raise ArithmeticError(f"the token constraints are not met after {STEPS} steps")


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _uniform(seed: str | Column) -> Column:
    return F.pmod(F.xxhash64(seed, "doc_id", "size"), F.lit(HASHES)) / float(HASHES)


def _movable(copies: Column, miss: Column) -> Column:
    return (F.abs(miss) > NEAR * F.col("target")) & (F.col("size") > 0) & (F.col("size") <= F.abs(miss)) & F.when(miss > 0, copies < CAP).otherwise(copies > 0)


def _with_copies(rows: DataFrame, state: DataFrame, near, repairs: int) -> DataFrame:
    """Copies of rows (doc_id, k, size, ...): the rounded rate, then the repairs found so far."""
    rate = _rate(F.col("lam"), F.col("size") / F.col("scale"), F.col("full"))
    copies = F.least(F.floor(rate + _uniform(F.lit(0).cast("long"))).cast("long"), F.lit(CAP).cast("long"))
    if repairs:
        # A fold, because nested columns would repeat the expression of every earlier step.
        found = F.array(*[F.struct(F.col(f"miss{t}").alias("miss"), (_uniform(f"seed{t}") < F.col(f"cut{t}")).alias("hit")) for t in range(repairs)])
        copies = F.aggregate(found, copies, lambda c, x: c + F.when(x["hit"] & _movable(c, x["miss"]), F.signum(x["miss"])).otherwise(0).cast("long"))
    return rows.join(near(state), "k").withColumn("copies", copies)


def _solve(docs: DataFrame) -> tuple:
    rows = settle(docs.select("doc_id", _key("source").alias("k"), "source", words(F.col("text")).alias("size")))
    histogram = settle(rows.groupBy("k", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    rows = rows.drop("source")
    sources = histogram.groupBy("k").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    near = F.broadcast if sources.count() <= SMALL_ROWS else (lambda df: df)
    params = targets(sources.drop("docs")).join(near(sources.select("k", "docs")), "k").select(
        "k", "source", "source_size", "target", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("scale"),
        (F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)).alias("full"),
    )
    start = [F.lit(1).cast("long").alias("zoom"), F.lit(1).cast("long").alias("seed"), F.lit(False).alias("done")]
    state, repairs = balance(histogram, params, near).select("*", *start), 0
    while True:
        now = _with_copies(rows, state, near, repairs)
        misses = settle(now.groupBy("k").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss")))
        place = F.floor(_uniform("seed") * F.col("zoom") * BINS)
        bins = now.join(near(misses), "k").where(~F.col("done") & _movable(F.col("copies"), F.col("miss")) & (place < BINS)).groupBy("k", "miss", "zoom", place.alias("bin")).agg(F.sum("size").alias("s"))
        run = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows of a source at most
        over = bins.withColumn("sum", F.sum("s").over(run)).groupBy("k").agg(F.min(F.when(F.col("sum") > F.abs("miss"), F.col("bin"))).alias("bin"), F.first("zoom").alias("z"))
        found = over.select("k", (F.coalesce("bin", F.lit(BINS)) / (F.col("z") * BINS)).alias("cut"), F.coalesce(F.col("bin") == 0, F.lit(False)).alias("crowded"))
        # A source is done when nothing movable is left, or only rows of one hash that are too many together.
        done = F.col("done") | F.col("cut").isNull() | (F.col("crowded") & (F.col("zoom") * BINS >= HASHES))
        state = state.join(near(misses), "k").join(near(found), "k", "left").withColumn("done", done)
        state = settle(state.select(
            *[c for c in state.columns if c not in ("zoom", "seed", "miss", "cut", "crowded")],
            F.col("miss").alias(f"miss{repairs}"), F.coalesce("cut", F.lit(0.0)).alias(f"cut{repairs}"), F.col("seed").alias(f"seed{repairs}"),
            F.when(F.col("crowded"), F.col("zoom") * BINS).otherwise(F.lit(1)).cast("long").alias("zoom"),
            F.when(F.col("crowded"), F.col("seed")).otherwise(F.col("seed") + 1).alias("seed"),
        ))
        repairs += 1
        if not state.where(~F.col("done")).limit(1).count():
            return rows, state, near, repairs


def mix(docs: DataFrame) -> DataFrame:
    """How often each row of `docs` (doc_id, text, source; others are ignored) is taken.

    Returns doc_id, size, source_size, target, taken, source, copies. Size counts words
    (null text: 0). Sources by code point, null last, weigh 1, 2, 3 in turn. A document without
    words is taken once; an empty table gives no rows. Copies are decided by a hash of doc_id and size, so reruns agree
    and repeated rows (null doc_ids of a size among them) are taken alike.
    """
    rows, state, near, repairs = _solve(docs)
    return _with_copies(rows, state, near, repairs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def repeat(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row of docs as often as mix() takes it, without a shuffle of the texts."""
    _, state, near, repairs = _solve(docs)
    wide = docs.select(F.struct("*").alias("_row"), "doc_id", _key("source").alias("k"), words(F.col("text")).alias("size"))
    return _with_copies(wide, state, near, repairs).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
