"""Vector and token queries over the embeddings; neighbours are consecutive vec_ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import tokens, vectors
from tracewell.operators import stats
from tracewell.plans.tables import table


def _vec(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("w"))


def _pairs(spark, d):
    """Each vector with its successor: base and tuned weights of one layer."""
    a = _vec(spark, d)
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("w").alias("t")), "vec_id").select("vec_id", "label", "w", F.zip_with("w", "t", lambda x, y: x + 0.1 * y).alias("t"))


def r6(c, name):
    return (F.round(c, 6) + 0.0).alias(name)


def vector_moments(spark, d):
    rows = _vec(spark, d).select("vec_id", F.explode("w").alias("x"))
    out = rows.groupBy("vec_id").agg(*[r6(m, n) for m, n in zip(stats.moments(F.col("x")), ("std", "max_abs", "excess_kurtosis"))])
    return out.join(stats.outlier_ratio(rows, "vec_id", "x", 2.0).select("vec_id", r6(F.col("outlier_ratio"), "outlier_ratio")), "vec_id")


def quant_roundtrip(spark, d):
    rows = _vec(spark, d).withColumn("q", vectors.quantize_strictly(F.col("w"), 4, 16))
    return rows.select("vec_id", F.posexplode("q").alias("i", "v")).select("vec_id", F.col("i").cast("int").alias("i"), r6(F.col("v"), "v"))


def gathered_logits(spark, d):
    """A student's logits at the places of its teacher's eight largest, the next row's vector standing for the teacher's."""
    rows = _vec(spark, d).select("vec_id", "w")
    order = F.array_sort(F.transform(F.col("w"), lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    teacher = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.transform(F.slice(order, 1, 8), lambda x: x["i"]).alias("ids"))
    found = rows.join(teacher, "vec_id").select("vec_id", F.posexplode(F.arrays_zip("ids", tokens.gather(F.col("w"), F.col("ids")).alias("z"))).alias("rank", "x"))
    return found.select("vec_id", F.col("rank").cast("int").alias("rank"), F.col("x.ids").cast("int").alias("id"), F.col("x.z").alias("z"))


def nmse_by_bits(spark, d):
    """Vectors x bit widths; the widths are a literal, so the product stays in one pass."""
    rows = _vec(spark, d).select("vec_id", F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), vectors.nmse(F.col("w"), vectors.quantize(F.col("w"), b, 32)).alias("nmse")) for b in (2, 3, 4, 6, 8)])).alias("x"))
    return rows.groupBy("x.bits").agg(r6(F.avg("x.nmse"), "nmse"), F.count("*").alias("n"))


def survival_ladder(spark, d):
    rows, parts = _pairs(spark, d), []
    for b in (3, 4, 8):
        s = vectors.survival(F.col("w"), F.col("t"), F.col(f"w{b}"), F.col(f"t{b}"))
        rows = rows.withColumn(f"w{b}", vectors.quantize(F.col("w"), b, 16)).withColumn(f"t{b}", vectors.quantize(F.col("t"), b, 16))
        parts.append(F.struct(F.lit(b).alias("bits"), *[c.alias(n) for n, c in s.items()]))
    out = rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return out.groupBy("bits").agg(*[r6(F.avg(c), c) for c in ("noise_rel", "kd_cos", "kd_rel_after", "kd_rel_before", "frac_erased", "frac_amplified")])


def split_precision(spark, d):
    rows = _pairs(spark, d).select("vec_id", "w", "t", vectors.split_precision(F.col("w"), F.col("t"), 4, 8, 16).alias("s"), vectors.quantize(F.col("t"), 4, 16).alias("j"))
    return rows.select("vec_id", r6(vectors.relative(F.col("s"), F.col("t")), "split_error"), r6(vectors.relative(F.col("j"), F.col("t")), "joint_error"), r6(vectors.update_in_steps(F.col("w"), F.col("t"), 4, 16), "steps"))


def grid_probe(spark, d):
    """Distinct levels in each group of a quantized and of a plain array."""
    rows = _vec(spark, d).select("vec_id", vectors.quantize(F.col("w"), 4, 32).alias("q"), "w")
    top = lambda c: F.array_max(vectors.distinct_levels(F.col(c), 32)).cast("int")
    out = rows.select("vec_id", top("q").alias("levels"), top("w").alias("plain"))
    return out.withColumn("is_w4", F.col("levels") <= 16)


def level_report(spark, d):
    """Distinct values, minimum, maximum and asymmetry over all 8-bit levels of a label."""
    rows = _vec(spark, d).select("label", F.explode(vectors.quantize(F.col("w"), 8, 0)).alias("x")).select("label", F.round("x", 6).alias("x"))
    return rows.groupBy("label").agg(F.countDistinct("x").alias("levels"), r6(F.min("x"), "low"), r6(F.max("x"), "high"), r6(F.abs(F.max("x") + F.min("x")), "offset"))


def gap_changes(spark, d):
    """Change points of window maxima (8 elements, change above 25 %): the median gap between them for each vector."""
    whole = F.floor(F.size("w") / 8).cast("int")  # a rest of fewer than 8 elements is no window
    w = F.transform(F.filter(F.sequence(F.lit(0), whole), lambda g: g < whole), lambda g: F.array_max(F.transform(F.slice("w", g * 8 + 1, F.lit(8)), F.abs)))
    rows = _vec(spark, d).select("vec_id", w.alias("m"))
    points = F.filter(F.sequence(F.lit(0), F.size("m")), lambda i: (i > 0) & (i < F.size("m")) & (F.abs(F.get("m", i) - F.get("m", i - 1)) > 0.25 * F.get("m", i - 1)))
    rows = rows.withColumn("p", points)
    gaps = F.array_sort(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i) - F.get("p", i - 1)))
    return rows.select("vec_id", F.size("p").alias("points"), F.when(F.size("p") > 1, F.get(gaps, F.floor((F.size("p") - 1) / 2).cast("int"))).alias("gap"))


def int8_error_weights(spark, d):
    rows = _vec(spark, d).select("vec_id", "label", vectors.norm(vectors.minus(F.col("w"), vectors.quantize_asymmetric(F.col("w")))).alias("e"))
    sums = rows.groupBy("label").agg(F.sum("e").alias("s"), F.count("*").alias("n"))
    return rows.join(sums, "label").select("vec_id", r6(F.when(F.col("s") > 0, F.col("e") * F.col("n") / F.col("s")).otherwise(1.0), "weight"))


def compare_to_reference(spark, d):
    """NMSE and relative error against another tensor, and the step that the error implies."""
    rows = _vec(spark, d).select("vec_id", "w", vectors.quantize(F.col("w"), 4, 16).alias("a"), vectors.quantize(F.col("w"), 8, 0).alias("b"))
    return rows.select("vec_id", r6(vectors.relative(F.col("a"), F.col("b")), "rel"), r6(vectors.nmse(F.col("b"), F.col("a")), "nmse"), r6(vectors.step_estimate(F.col("w"), F.col("a")), "step"))


def depth_bins(spark, d):
    """Thirds of the depth range; an empty bin has a mean of NaN."""
    rows = _vec(spark, d).select((F.col("vec_id") % 18).alias("layer"), vectors.largest(F.col("w")).alias("x"))
    bounds = [("early", 0, 8), ("middle", 9, 17), ("late", 18, 27)]
    name = F.lit(None)
    for label, low, high in bounds:
        name = F.when(F.col("layer").between(low, high), label).otherwise(name)
    found = rows.groupBy(name.alias("depth")).agg(r6(F.avg("x"), "mean"), F.count("*").alias("n"), F.count_if(F.col("x") > 0.35).alias("worse"))
    bins = spark.createDataFrame([(label,) for label, _, _ in bounds], "depth string").join(F.broadcast(found), "depth", "left").fillna(0, ["n", "worse"])
    return bins.select("depth", F.coalesce("mean", F.lit(float("nan"))).alias("mean"), "n", F.format_string("%d/%d", "worse", "n").alias("worse"))


def top_metrics(spark, d):
    """The five largest by a metric."""
    return _vec(spark, d).select("vec_id", r6(vectors.largest(F.col("w")), "max_abs")).orderBy(F.desc("max_abs"), "vec_id").limit(5)


def size_by_bits(spark, d):
    rows = _vec(spark, d).select((F.size("w") * 4).cast("bigint").alias("b"))
    return rows.agg(F.sum("b").alias("fp32"), (F.sum("b") / 2).alias("bf16"), (F.sum("b") / 4).alias("int8"), (F.sum("b") / 8).alias("int4"))


def _dist(spark, d):
    """A vector's components as logits."""
    return _vec(spark, d).select("vec_id", "label", F.transform("w", lambda x: x * 10).alias("z"))


def topk_normalize(spark, d):
    entries = F.transform("w", lambda x, i: F.struct(F.when(i < 32, i).otherwise(i - 20).cast("bigint").alias("id"), (x * 5).alias("logprob")))
    rows = _vec(spark, d).select("vec_id", tokens.normalize_top_k(entries, 5, 2.0, 40).alias("t"))
    return rows.select("vec_id", F.posexplode("t").alias("k", "e")).select("vec_id", F.col("k").cast("int").alias("k"), F.col("e.id").alias("id"), r6(F.col("e.p"), "p"))


def entropy_weights(spark, d):
    rows = _dist(spark, d).withColumn("p", tokens.softmax(F.col("z")))
    return rows.select("vec_id", r6(tokens.entropy(F.col("p")), "entropy"), r6(tokens.effective_k(F.col("p")), "effective_k"), r6(tokens.confidence(F.col("p")), "confidence"), r6(tokens.entropy_focus(F.col("p")), "focus"))


def soft_signal(spark, d):
    """Distribution statistics: mean effective k, mean top-1, shares beyond thresholds."""
    rows = _dist(spark, d).withColumn("p", tokens.softmax(F.col("z"))).select(tokens.effective_k(F.col("p")).alias("k"), F.array_max("p").alias("top"))
    return rows.agg(r6(F.avg("k"), "effective_k"), r6(F.avg("top"), "top_1"), F.count_if(F.col("top") > 0.9).alias("peaked"), F.count_if(F.col("k") > 4).alias("broad"))


def _two(spark, d):
    a = _dist(spark, d)
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("z").alias("y")), "vec_id").select("vec_id", "label", tokens.softmax(F.col("z")).alias("p"), tokens.softmax(F.col("y")).alias("q"))


def skew_kl(spark, d):
    """Skewed divergence of each pair, and per label the weighted loss, its mix with cross entropy and the adaptive skew."""
    rows = _two(spark, d).withColumn("l", tokens.skew_kl(F.col("p"), F.col("q"), 0.9)).withColumn("ce", -F.log(F.get("q", F.lit(0)))).withColumn("w", tokens.entropy_focus(F.col("p")))
    out = rows.groupBy("label").agg(tokens.weighted_mean(F.col("l"), F.col("w")).alias("loss"), F.avg("ce").alias("ce"))
    return out.select("label", r6(F.col("loss"), "loss"), r6(0.7 * F.col("loss") + 0.3 * F.col("ce"), "mixed"), r6(tokens.adaptive_lambda(F.col("loss"), 0.5, 0.9), "lambda"))


def top1_agreement(spark, d):
    """Argmax agreement, mean divergence, mean entropy where they agree, and how often the one's first is not in the other's top 3."""
    rows = _two(spark, d).withColumn("same", tokens.argmax(F.col("p")) == tokens.argmax(F.col("q")))
    top3 = F.slice(F.array_sort(F.transform("q", lambda x: -x)), 3, 1)
    fell = -F.get("q", tokens.argmax(F.col("p")).cast("int")) > F.get(top3, F.lit(0))
    return rows.agg(r6(F.avg(F.col("same").cast("double")), "agreement"), r6(F.avg(tokens.kl(F.col("p"), F.col("q"))), "kl"), r6(F.avg(F.when(F.col("same"), tokens.entropy(F.col("p")))), "entropy_same"), F.count_if(fell).alias("fell_out"))


def offset_align(spark, d):
    """Teacher rows placed at prompt length - 1, clipped to the sequence; positions without one get zeros."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("pl"), F.count("*").alias("n"))
    teacher = rows.select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") + 1)).alias("t"), "pl").select("conv_id", (F.col("t") + F.col("pl") - 1).alias("pos"), (F.col("t") + 1).alias("v"))
    slots = rows.select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") + 1)).alias("pos"))
    return slots.join(teacher, ["conv_id", "pos"], "left").select("conv_id", "pos", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))


def score_tables_join(spark, d):
    """Ids present in all four score tables with equal lengths, paired by position."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("idx"), F.col("turn").alias("pos"), "role").distinct()
    parts = [t.where(c).select("idx", "pos", F.lit(1).alias(f"s{i}")) for i, c in enumerate(("true", "pos < 6", "idx % 2 = 0", "role <> 'system'"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["idx", "pos"])
    return out.groupBy("idx").agg(F.count("*").alias("positions"))


_W = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings)"
_S = lambda a: f"list_sum(list_transform({a}, lambda x: x * x))"


def _grp(w: str, size: int) -> str:
    return f"list_transform(range(0, {64 // size}), lambda g: {w}[g * {size} + 1 : (g + 1) * {size}])" if size else f"[{w}]"


def _step(g: str, bits: int) -> str:
    return f"(greatest(list_max(list_transform({g}, lambda x: abs(x))), 1e-8) / {2 ** (bits - 1) - 1})"


def _q(w: str, bits: int, size: int) -> str:
    m = 2 ** (bits - 1) - 1
    return f"flatten(list_transform({_grp(w, size)}, lambda h: list_transform(h, lambda v: greatest(least(round_even(v / {_step('h', bits)}, 0), {m}.0), {-m - 1}.0) * {_step('h', bits)})))"


def _minus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


_P = f"{_W}, p AS (SELECT a.vec_id, a.label, a.w, list_transform(list_zip(a.w, b.w), lambda z: z[1] + 0.1::DOUBLE * z[2]) AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"
_Z = f"{_W}, z1 AS (SELECT vec_id, label, list_transform(w, lambda x: x * 10) AS z FROM e), z2 AS (SELECT *, list_max(z) AS top FROM z1), z3 AS (SELECT *, list_transform(z, lambda x: exp(x - top)) AS ex FROM z2), z4 AS (SELECT *, list_sum(ex) AS mass FROM z3), s AS (SELECT vec_id, label, list_transform(ex, lambda x: x / mass) AS p FROM z4)"
_H = "list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0.0 END))"
_TWO = f"{_Z}, two AS (SELECT a.vec_id, a.label, a.p, b.p AS q FROM s a JOIN s b ON b.vec_id = a.vec_id + 1)"
_KL = lambda lam: f"list_sum(list_transform(list_zip(p, q), lambda v: v[1] * (ln(greatest(v[1], 1e-10)) - ln(greatest({lam}::DOUBLE * v[2] + (1 - {lam}::DOUBLE) * v[1], 1e-10)))))"
_LADDER = " UNION ALL ".join(f"SELECT {b} AS bits, w, t, {_q('w', b, 16)} AS wq, {_q('t', b, 16)} AS tq FROM p" for b in (3, 4, 8))
_DQ, _D = _minus("tq", "wq"), _minus("t", "w")
ORACLES = {
    "vector_moments": "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s, max(abs(x)) AS a, kurtosis_pop(x) AS k FROM x GROUP BY vec_id) SELECT vec_id, round(any_value(s), 6) AS std, round(any_value(a), 6) AS max_abs, round(any_value(k), 6) AS excess_kurtosis, round(avg((abs(x - m) > 2 * s)::INT), 6) AS outlier_ratio FROM x JOIN m USING (vec_id) GROUP BY vec_id",
    "gathered_logits": f"WITH {_W}, t AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY w[i] DESC, i) AS rank FROM e, range(1, 65) r(i)) SELECT s.vec_id, (rank - 1)::INT AS rank, (i - 1)::INT AS id, w[i] AS z FROM t JOIN e s ON s.vec_id = t.vec_id - 1 WHERE rank <= 8",
    "quant_roundtrip": f"WITH {_W}, q AS (SELECT vec_id, {_q('w', 4, 16)} AS q FROM e) SELECT vec_id, (generate_subscripts(q, 1) - 1)::INT AS i, round(unnest(q), 6) + 0.0 AS v FROM q",
    "nmse_by_bits": f"WITH {_W}, u AS (" + " UNION ALL ".join(f"SELECT {b} AS bits, w, {_q('w', b, 32)} AS q FROM e" for b in (2, 3, 4, 6, 8)) + f") SELECT bits, round(avg({_S(_minus('w', 'q'))} / {_S('w')}), 6) AS nmse, count(*) AS n FROM u GROUP BY bits",
    "survival_ladder": f"WITH {_P}, u AS ({_LADDER}), v AS (SELECT bits, w, wq, {_D} AS d, {_DQ} AS dq FROM u) SELECT bits, round(avg(sqrt({_S(_minus('dq', 'd'))}) / sqrt({_S('d')})), 6) AS noise_rel, round(avg(list_sum(list_transform(list_zip(d, dq), lambda z: z[1] * z[2])) / (sqrt({_S('d')}) * sqrt({_S('dq')}))), 6) AS kd_cos, round(avg(sqrt({_S('dq')}) / sqrt({_S('wq')})), 6) AS kd_rel_after, round(avg(sqrt({_S('d')}) / sqrt({_S('w')})), 6) AS kd_rel_before, round(avg(len(list_filter(list_zip(d, dq), lambda z: abs(z[2]) < 0.1::DOUBLE * abs(z[1])))::DOUBLE / 64), 6) AS frac_erased, round(avg(len(list_filter(list_zip(d, dq), lambda z: abs(z[2]) > 2 * abs(z[1])))::DOUBLE / 64), 6) AS frac_amplified FROM v GROUP BY bits",
    "split_precision": f"WITH {_P}, u AS (SELECT vec_id, w, t, {_q('w', 4, 16)} AS bq, {_q(_minus('t', 'w'), 8, 16)} AS dq, {_q('t', 4, 16)} AS j, list_transform({_grp('t', 16)}, lambda g: {_step('g', 4)}) AS st FROM p), v AS (SELECT *, list_transform(list_zip(bq, dq), lambda z: z[1] + z[2]) AS s FROM u) SELECT vec_id, round(sqrt({_S(_minus('s', 't'))}) / sqrt({_S('t')}), 6) AS split_error, round(sqrt({_S(_minus('j', 't'))}) / sqrt({_S('t')}), 6) AS joint_error, round(sqrt({_S(_minus('t', 'w'))} / 64) / (list_sum(st) / 4), 6) AS steps FROM v",
    "grid_probe": f"WITH {_W}, u AS (SELECT vec_id, w, {_q('w', 4, 32)} AS q FROM e), v AS (SELECT vec_id, greatest(len(list_distinct(list_transform(q[1:32], lambda x: x + 0.0))), len(list_distinct(list_transform(q[33:64], lambda x: x + 0.0))))::INT AS levels, greatest(len(list_distinct(list_transform(w[1:32], lambda x: x + 0.0))), len(list_distinct(list_transform(w[33:64], lambda x: x + 0.0))))::INT AS plain FROM u) SELECT *, levels <= 16 AS is_w4 FROM v",
    "level_report": f"WITH {_W}, u AS (SELECT label, round(unnest({_q('w', 8, 0)}), 6) AS x FROM e) SELECT label, count(DISTINCT x) AS levels, round(min(x), 6) AS low, round(max(x), 6) AS high, round(abs(max(x) + min(x)), 6) AS \"offset\" FROM u GROUP BY label",
    "gap_changes": f"WITH {_W}, m AS (SELECT vec_id, list_transform(range(0, len(w) // 8), lambda g: list_max(list_transform(w[g * 8 + 1 : g * 8 + 8], lambda x: abs(x)))) AS m FROM e), p AS (SELECT vec_id, list_filter(range(1, len(m)), lambda i: abs(m[i + 1] - m[i]) > 0.25::DOUBLE * m[i]) AS p FROM m) SELECT vec_id, len(p)::INT AS points, CASE WHEN len(p) > 1 THEN list_sort(list_transform(range(2, len(p) + 1), lambda i: p[i] - p[i - 1]))[(len(p) - 1) // 2 + 1] END::INT AS gap FROM p",
    "int8_error_weights": f"WITH {_W}, a AS (SELECT vec_id, label, w, list_min(w) AS lo, greatest((list_max(w) - list_min(w)) / 255, 1e-8) AS sc FROM e), b AS (SELECT vec_id, label, sqrt({_S('list_transform(w, lambda y: y - (greatest(least(round_even((y - lo) / sc, 0), 255.0), 0.0) * sc + lo))')}) AS er FROM a) SELECT vec_id, round(CASE WHEN sum(er) OVER g > 0 THEN er * count(*) OVER g / sum(er) OVER g ELSE 1.0 END, 6) AS weight FROM b WINDOW g AS (PARTITION BY label)",
    "compare_to_reference": f"WITH {_W}, u AS (SELECT vec_id, w, {_q('w', 4, 16)} AS a, {_q('w', 8, 0)} AS b FROM e) SELECT vec_id, round(sqrt({_S(_minus('a', 'b'))}) / sqrt({_S('b')}), 6) AS rel, round({_S(_minus('b', 'a'))} / {_S('b')}, 6) AS nmse, round(sqrt({_S(_minus('w', 'a'))} / 64) * sqrt(12.0), 6) AS step FROM u",
    "depth_bins": f"WITH {_W}, u AS (SELECT vec_id % 18 AS layer, list_max(list_transform(w, lambda x: abs(x))) AS x FROM e), b(depth, low, high) AS (VALUES ('early', 0, 8), ('middle', 9, 17), ('late', 18, 27)) SELECT depth, coalesce(round(avg(x), 6), 'nan'::DOUBLE) AS mean, count(x) AS n, (count(*) FILTER (x > 0.35::DOUBLE)) || '/' || count(x) AS worse FROM b LEFT JOIN u ON layer BETWEEN low AND high GROUP BY 1",
    "top_metrics": f"WITH {_W} SELECT vec_id, round(list_max(list_transform(w, lambda x: abs(x))), 6) AS max_abs FROM e ORDER BY max_abs DESC, vec_id LIMIT 5",
    "size_by_bits": "SELECT sum(len(embedding) * 4)::BIGINT AS fp32, sum(len(embedding) * 4) / 2.0::DOUBLE AS bf16, sum(len(embedding) * 4) / 4.0::DOUBLE AS int8, sum(len(embedding) * 4) / 8.0::DOUBLE AS int4 FROM embeddings",
    "topk_normalize": f"""WITH {_W}, x AS (SELECT vec_id, unnest(range(0, 64)) AS i, w FROM e), y AS (SELECT vec_id, i, CASE WHEN i < 32 THEN i ELSE i - 20 END AS id, exp(w[i + 1] * 5 / 2.0::DOUBLE) AS p FROM x), g AS (SELECT vec_id, id, sum(p) AS p, min(i) AS i FROM y WHERE id < 40 AND p > 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS k FROM g) SELECT vec_id, (k - 1)::INT AS k, id, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS p FROM r WHERE k <= 5""",
    "entropy_weights": f"WITH {_Z}, h AS (SELECT vec_id, {_H} AS h FROM s) SELECT vec_id, round(h, 6) AS entropy, round(exp(h), 6) AS effective_k, round(1 - greatest(least(h / ln(64.0), 1.0), 0.0), 6) + 0.0 AS confidence, round(greatest(least(h / ln(64.0), 1.0), 0.0) * 0.7::DOUBLE + 0.3::DOUBLE, 6) AS focus FROM h",
    "soft_signal": f"WITH {_Z}, h AS (SELECT exp({_H}) AS k, list_max(p) AS top FROM s) SELECT round(avg(k), 6) AS effective_k, round(avg(top), 6) AS top_1, count(*) FILTER (top > 0.9::DOUBLE) AS peaked, count(*) FILTER (k > 4) AS broad FROM h",
    "skew_kl": f"WITH {_TWO}, l AS (SELECT label, {_KL(0.9)} AS l, -ln(q[1]) AS ce, greatest(least({_H} / ln(64.0), 1.0), 0.0) * 0.7::DOUBLE + 0.3::DOUBLE AS wt FROM two), g AS (SELECT label, sum(l * wt) / greatest(sum(wt), 1e-8) AS loss, avg(ce) AS ce FROM l GROUP BY label) SELECT label, round(loss, 6) AS loss, round(0.7::DOUBLE * loss + 0.3::DOUBLE * ce, 6) AS mixed, round(greatest(least(0.5::DOUBLE + 0.4::DOUBLE * tanh(loss / 4), 0.9::DOUBLE), 0.5::DOUBLE), 6) AS \"lambda\" FROM g",
    "top1_agreement": f"WITH {_TWO}, u AS (SELECT p, q, list_position(p, list_max(p)) AS a, list_position(q, list_max(q)) AS b FROM two) SELECT round(avg((a = b)::INT), 6) AS agreement, round(avg({_KL(1.0)}), 6) AS kl, round(avg(CASE WHEN a = b THEN {_H} END), 6) AS entropy_same, count(*) FILTER (q[a] < list_reverse_sort(q)[3]) AS fell_out FROM u",
    "offset_align": "WITH r AS (SELECT conv_id, max(turn) AS pl, count(*) AS n FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, unnest(range(0, n + 2)) AS pos, pl FROM r) SELECT conv_id, pos, CASE WHEN pos - pl + 1 >= 0 THEN pos - pl + 2 ELSE 0 END AS v FROM s",
    "score_tables_join": "WITH t AS (SELECT DISTINCT conv_id AS idx, turn AS pos, role FROM conversations) SELECT idx, count(*) AS positions FROM t WHERE pos < 6 AND idx % 2 = 0 AND role <> 'system' GROUP BY idx",
}
QUERIES = {name: globals()[name] for name in ORACLES}
