"""Sparse token distributions as Spark expressions.

A distribution is an array of structs (id, p) by descending p.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, f) -> Column:
    """f(value), with value computed once: inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(z: Column, temperature: float = 1.0) -> Column:
    t = max(temperature, 1e-6)
    e = bound(F.struct(z.alias("z"), F.array_max(z).alias("top")), lambda b: F.transform(b["z"], lambda x: F.exp((x - b["top"]) / t)))
    return bound(e, lambda e: bound(F.struct(e.alias("e"), total(e).alias("sum")), lambda b: F.transform(b["e"], lambda x: x / b["sum"])))


def normalize_top_k(entries: Column, k: int, temperature: float, vocab: int) -> Column:
    """(id, logprob) entries -> the k likeliest ids with p = exp(logprob / T), duplicates merged, renormalized, zero-padded to k.

    Ids outside the vocabulary and zero probabilities go; ties keep the order of entry.
    """
    t = max(temperature, 1e-6)
    good = F.filter(F.transform(entries, lambda e: F.struct(e["id"].alias("id"), F.exp(e["logprob"] / t).alias("p"))), lambda e: (e["id"] >= 0) & (e["id"] < vocab) & (e["p"] > 0))
    ids = lambda good: F.array_distinct(F.transform(good, lambda e: e["id"]))
    merged = bound(good, lambda good: F.transform(ids(good), lambda i, n: F.struct((-total(F.transform(F.filter(good, lambda e: e["id"] == i), lambda e: e["p"]))).alias("m"), n.alias("n"), i.alias("id"))))
    top = F.slice(F.array_sort(merged), 1, k)
    massed = lambda top: F.struct(top.alias("top"), total(F.transform(top, lambda e: -e["m"])).alias("mass"))
    found = bound(top, lambda top: bound(massed(top), lambda b: F.transform(b["top"], lambda e: F.struct(e["id"].alias("id"), (-e["m"] / b["mass"]).alias("p")))))
    return F.concat(found, F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("p")), F.lit(k) - F.size(found)))


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def effective_k(p: Column) -> Column:
    return F.exp(entropy(p))


def confidence(p: Column) -> Column:
    """1 - H / log(max(k, 2)) over the k nonzero entries, clamped; 0 if there are none."""
    k = F.size(F.filter(p, lambda x: x > 0))
    h = entropy(p) / F.log(F.greatest(k, F.lit(2)).cast("double"))
    return F.when(k == 0, 0.0).otherwise(1 - F.greatest(F.least(h, F.lit(1.0)), F.lit(0.0)))


def entropy_focus(p: Column, floor: float = 0.3) -> Column:
    """Weight from `floor` to 1 by entropy over its maximum; 0 if there are no entries."""
    h = entropy(p) / F.log(F.greatest(F.size(p), F.lit(2)).cast("double"))
    return F.when(F.size(F.filter(p, lambda x: x > 0)) == 0, 0.0).otherwise(F.greatest(F.least(h, F.lit(1.0)), F.lit(0.0)) * (1 - floor) + floor)


def skew_kl(p: Column, q: Column, lam: float) -> Column:
    """sum p (log max(p, 1e-10) - log max(lam q + (1 - lam) p, 1e-10))."""
    low = F.lit(1e-10)
    return total(F.zip_with(p, q, lambda x, y: x * (F.log(F.greatest(x, low)) - F.log(F.greatest(lam * y + (1 - lam) * x, low)))))


def kl(p: Column, q: Column) -> Column:
    return skew_kl(p, q, 1.0)


def gather(z: Column, ids: Column) -> Column:
    """z[id] for each id."""
    return F.transform(ids, lambda i: F.get(z, i.cast("int")))


def argmax(a: Column) -> Column:
    """0-based place of the maximum, the first on ties."""
    return F.array_position(a, F.array_max(a)) - 1


def adaptive_lambda(divergence: Column, start: float, top: float) -> Column:
    return F.greatest(F.least(start + (top - start) * F.tanh(divergence / 4), F.lit(top)), F.lit(start))


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(w v) / max(sum w, 1e-8), as an aggregate."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1e-8))
