"""Kernels on arrays of doubles as Spark expressions: quantization, error and direction measures.

A group's scale is computed once, in a projection of its own, and not inside a transform. Rounding is half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def groups(w: Column, size: int) -> Column:
    """Cut an array into groups of `size` (0: one group); null if it does not divide."""
    if not size:
        return F.array(w)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) / size - 1, F.lit(0)).cast("int")), lambda g: F.slice(w, g * size + 1, F.lit(size)))
    return F.when(F.size(w) % size == 0, cut)


def largest(w: Column) -> Column:
    return F.array_max(F.transform(w, F.abs))


def steps(w: Column, bits: int, size: int) -> Column:
    """Step of each group: max(max |w|, 1e-8) / qmax."""
    q = 2 ** (bits - 1) - 1
    return F.transform(groups(w, size), lambda g: F.greatest(largest(g), F.lit(1e-8)) / q)


def quantized(w: Column, scales: Column, bits: int, size: int) -> Column:
    """Symmetric round trip with given steps."""
    q = 2 ** (bits - 1) - 1
    one = lambda g, s: F.transform(g, lambda x: F.greatest(F.least(F.rint(x / s), F.lit(float(q))), F.lit(float(-q - 1))) * s)
    return F.flatten(F.zip_with(groups(w, size), scales, one))


def quantize(w: Column, bits: int, size: int = 0) -> Column:
    """Symmetric group quantization round trip; 16 bits leave the array alone, and so does a size that does not divide it."""
    if bits >= 16:
        return w
    return F.coalesce(quantized(w, steps(w, bits, size), bits, size), w)


def quantize_strictly(w: Column, bits: int, size: int = 0) -> Column:
    """The same, but a size that does not divide an array is an error."""
    if not size or bits >= 16:
        return quantize(w, bits, size)
    return F.when(F.size(w) % size == 0, quantize(w, bits, size)).when(w.isNotNull(), F.raise_error(F.concat(F.lit(f"groups of {size} do not divide a row of "), F.size(w).cast("string"))))


def quantize_asymmetric(w: Column) -> Column:
    """8 bits per row from minimum and maximum: clamp(rint((w - min) / scale), 0, 255) scale + min."""
    low = F.array_min(w)
    scale = F.greatest((F.array_max(w) - low) / 255, F.lit(1e-8))
    return F.transform(w, lambda x: F.greatest(F.least(F.rint((x - low) / scale), F.lit(255.0)), F.lit(0.0)) * scale + low)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def square(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(square(a))


def nmse(w: Column, q: Column) -> Column:
    """Error energy over signal energy; NaN for a zero array."""
    return F.when(square(w) > 0, square(minus(w, q)) / square(w)).otherwise(F.lit(float("nan")))


def relative(a: Column, b: Column) -> Column:
    """|a - b| / |b|, 0 if b is zero."""
    return F.when(square(b) > 0, norm(minus(a, b)) / norm(b)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(float("nan")))


def survival(base: Column, tuned: Column, base_q: Column, tuned_q: Column) -> dict[str, Column]:
    """How much of the update tuned - base is left after quantization."""
    d, dq = minus(tuned, base), minus(tuned_q, base_q)
    share = lambda test: F.size(F.filter(F.zip_with(d, dq, test), lambda x: x)) / F.size(d)
    return {
        "noise_rel": norm(minus(dq, d)) / norm(d), "kd_cos": cosine(d, dq), "kd_rel_after": norm(dq) / norm(base_q), "kd_rel_before": norm(d) / norm(base),
        "frac_erased": share(lambda x, y: F.abs(y) < 0.1 * F.abs(x)), "frac_amplified": share(lambda x, y: F.abs(y) > 2 * F.abs(x)),
    }


def distinct_levels(w: Column, size: int) -> Column:
    """Distinct values of each group (zeros of either sign are one): at most 2^bits if it was quantized."""
    return F.transform(groups(w, size), lambda g: F.size(F.array_distinct(F.transform(g, lambda x: x + 0.0))))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def update_in_steps(base: Column, tuned: Column, bits: int, size: int) -> Column:
    """Root mean square of the update over the mean step of the tuned array."""
    d = minus(tuned, base)
    return F.sqrt(square(d) / F.size(d)) / mean(steps(tuned, bits, size))


def split_precision(base: Column, tuned: Column, base_bits: int, delta_bits: int, size: int) -> Column:
    """The base at one width plus the update at another."""
    return plus(quantize(base, base_bits, size), quantize(minus(tuned, base), delta_bits, size))


def step_estimate(w: Column, q: Column) -> Column:
    """Root mean square error times sqrt(12): the step that uniform rounding error implies."""
    return F.sqrt(square(minus(w, q)) / F.size(w)) * F.sqrt(F.lit(12.0))


def running(lengths: Column, block: int = 512) -> Column:
    """Sums of all earlier elements of an array of ints, by blocks: an array that grows element by element is copied each time, so only short ones do."""
    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(a, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all")))

    cut = F.transform(F.sequence(F.lit(0), (F.greatest(F.size(lengths), F.lit(1)) - 1).cast("int"), F.lit(block)), lambda at: sums(F.slice(lengths, at + 1, block)))
    spread = lambda b: F.zip_with(b, sums(F.transform(b, lambda x: x["sum"]))["all"], lambda x, first: F.transform(x["all"], lambda v: v + first))
    return F.flatten(F.get(F.transform(F.array(cut), spread), F.lit(0)))
