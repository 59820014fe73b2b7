"""Statistical queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import stats
from tracewell.operators.ordering import materialized
from tracewell.plans.tables import table

#: As many resamples as the published figures rest on. Those of pairs follow from md5 hashes, which SQL repeats; those of clusters are numpy's draws.
ITERS = 20_000


def _pair(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "lang")
    a = labels.select(F.col("doc_id").alias("idx"), (F.col("quality") == 1).alias("solved"))
    b = labels.select(F.col("doc_id").alias("idx"), (F.col("toxic") == 0).alias("solved"))
    return docs.join(a, "idx"), b


def mcnemar_by_lang(spark, d):
    a, b = _pair(spark, d)
    p = stats.mcnemar(F.col("b"), F.col("c"))
    return stats.paired(a, b, ["lang"]).withColumn("p", p).select("lang", "n", "solved_a", "solved_b", "b", "c", F.round("p", 6).alias("p"), stats.stars(F.col("p")).alias("stars"))


#: Pairs of lines as pairs of models; two have a side that does not exist.
_SPECS = [(f"t{i}", f"line{a}", f"line{b}") for i, (a, b) in enumerate([(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (2, 3), (2, 5), (2, 7), (3, 4), (3, 6), (4, 5), (5, 6), (6, 7), (1, 8), (9, 2)], 1)]


def test_suite(spark, d):
    """A table of test specifications joined twice to the outcomes; a missing side is reported as skipped."""
    rows = table(spark, d, "lineitem").groupBy(F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("model"), F.col("l_orderkey").alias("idx")).agg(F.bool_or(F.col("l_linestatus") == "O").alias("solved"))
    spec = spark.createDataFrame(_SPECS, "test string, a string, b string")
    x = spec.join(rows.select(F.col("model").alias("a"), "idx", F.col("solved").alias("x")), "a").select("test", "idx", "x")
    y = spec.join(rows.select(F.col("model").alias("b"), "idx", F.col("solved").alias("y")), "b").select("test", "idx", "y")
    counts = x.join(y, ["test", "idx"]).groupBy("test").agg(F.count("*").alias("n"), F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(F.col("y") & ~F.col("x")).alias("c"))
    out = spec.select("test").join(counts, "test", "left").withColumn("p", stats.mcnemar(F.col("b"), F.col("c")))
    return out.select("test", "n", "b", "c", F.when(F.col("n").isNotNull(), F.round("p", 6)).alias("p"), F.col("n").isNull().alias("skipped"))


def pairwise_intervals(spark, d):
    """Exact test and bootstrap interval side by side for each language."""
    a, b = _pair(spark, d)
    counts = stats.paired(a, b, ["lang"]).select("lang", "n", "b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))
    low, high = stats.interval_places(ITERS)
    return stats.grouped_intervals(counts, ["lang", "n", "b", "c", "p"], ITERS, {"low": low, "high": high})


def paired_diff(spark, d):
    a, b = _pair(spark, d)
    return stats.paired(a, b, []).withColumn("diff", F.col("c") - F.col("b"))


def bootstrap_ci(spark, d):
    a, b = _pair(spark, d)
    low, high = stats.interval_places(ITERS)
    return stats.order_statistics(stats.bootstrap_sums(stats.paired(a, b, []), ITERS), "total", {"low": low, "high": high})


def tost_bound(spark, d):
    a, b = _pair(spark, d)
    counts = stats.paired(a, b, [])
    low, high = stats.interval_places_minus_one(ITERS, 0.9)
    ends = stats.order_statistics(stats.bootstrap_sums(counts, ITERS), "total", {"low": low, "high": high})
    both = ends.crossJoin(counts.select("n"))
    bound, percent, verdict = stats.equivalence(F.col("low"), F.col("high"), 10.0, F.col("n"))
    return both.select("low", "high", "n", bound, F.round(percent, 6).alias("bound_percent"), verdict)


def clustered_bootstrap(spark, d):
    """Clusters (users) are resampled, not rows: mean of the clusters' rate differences."""
    rates = table(spark, d, "events").groupBy("user_id").agg((F.avg((F.col("event_type") == "click").cast("double")) - F.avg((F.col("event_type") == "view").cast("double"))).alias("delta"))
    means = stats.clustered_bootstrap_means(rates, "delta", ITERS)
    low, high = stats.interval_places(ITERS)
    return stats.order_statistics(means, "mean", {"low": low, "high": high}).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def agreement_rate(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.round(F.coalesce(F.avg((F.col("event_type") == "click").cast("double")), F.lit(0.0)), 6).alias("rate"))
    return rows


def _measures(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("s"), F.col("l_tax").alias("t"))


def correlation_suite(spark, d):
    """Pearson and Spearman of four pairs of columns, by flag, each with its p value."""
    rows = _measures(spark, d)
    ranked = rows
    for column in "qest":
        ranked = stats.average_rank(ranked, ["l_returnflag"], column, f"r{column}", rows)
    c = lambda x, y, name: stats.correlation(F.col(x), F.col(y)).alias(name)
    found = ranked.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[x for a, b in ("qe", "qs", "es", "et") for x in (c(a, b, f"pearson_{a}{b}"), c(f"r{a}", f"r{b}", f"spearman_{a}{b}"))])
    found = materialized(found)  # a row for each flag, whose correlations are used many times
    rs = [n for n in found.columns if n[0] in "ps"]
    return found.select("l_returnflag", *[F.round(n, 6).alias(n) for n in rs], *[F.round(stats.correlation_p(F.col(n), F.col("n")), 7).alias(f"p_{n}") for n in rs])


def spearman(spark, d):
    rows = _measures(spark, d).withColumn("all", F.lit(1))
    ranked = stats.average_rank(stats.average_rank(rows, ["all"], "q", "rq"), ["all"], "e", "re")
    return ranked.agg(F.round(stats.correlation(F.col("rq"), F.col("re")), 6).alias("rho"), F.count("*").alias("n"))


def nan_statistics(spark, d):
    """NaN-skipping mean and true median."""
    x = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    rows = table(spark, d, "lineitem").select("l_returnflag", x.alias("x"))
    means = rows.groupBy("l_returnflag").agg(F.round(stats.nan_mean(F.col("x")), 6).alias("mean"), F.count_if(F.isnan("x")).alias("skipped"))
    return means.join(stats.medians(rows, ["l_returnflag"], "x"), "l_returnflag", "left")


def cache_profile(spark, d):
    """Totals, empties, truncations and place percentiles of document lengths."""
    rows = table(spark, d, "documents").select("n_chars", "text")
    places = stats.place_percentiles(rows, "n_chars", {"p50": 0.5, "p90": 0.9})
    cap = 4000
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.col("n_chars") >= cap - 50).alias("truncated"), F.max("n_chars").alias("longest"))
    return counts.crossJoin(places)


def alignment_report(spark, d):
    """Median and largest absolute difference of two lengths, and the share above 2."""
    rows = table(spark, d, "documents").select(F.abs(F.col("n_chars") - 5 * F.size(F.split("text", " "))).cast("bigint").alias("delta"))
    return stats.place_percentiles(rows, "delta", {"median": 0.5}).crossJoin(rows.agg(F.max("delta").alias("largest"), F.round(F.avg((F.col("delta") > 2).cast("double")), 6).alias("above")))


_COUNTS = """p AS (SELECT quality = 1 AS x, toxic = 0 AS y FROM labels JOIN documents USING (doc_id)),
k AS (SELECT count(*) AS n, count(*) FILTER (x) AS solved_a, count(*) FILTER (y) AS solved_b, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (y AND NOT x) AS c FROM p)"""
_P = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"

def _binomial(n: str, k: str, p: str) -> str:
    return f"CASE WHEN {p} <= 0 THEN ({k} = 0)::INT::DOUBLE WHEN {p} >= 1 THEN ({k} = {n})::INT::DOUBLE ELSE exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p})) END"


#: Of counts k (lang, n, b, c): the sums of each of 20,000 resamples, sorted, by whole tables of both binomial distributions.
_RESAMPLED = f"""r AS (SELECT i, {', '.join(f"(('0x' || substr(md5('20240515:' || i || ':{j}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u{j}" for j in (0, 1))} FROM range(20000) t(i)),
q AS (SELECT *, (b + c) / n::DOUBLE AS p1, CASE WHEN b + c = 0 THEN 0 ELSE c / (b + c)::DOUBLE END AS p2 FROM k),
h1 AS (SELECT lang, p2, d, sum({_binomial('n', 'd', 'p1')}) OVER (PARTITION BY lang ORDER BY d) AS upto FROM (SELECT *, unnest(range(0, CASE WHEN p1 <= 0 THEN 1 ELSE n + 1 END)) AS d FROM q)),
x1 AS (SELECT q.lang, r.u0, r.u1 FROM q, r),
d1 AS (SELECT x1.lang, x1.u1, h1.d, h1.p2 FROM x1 ASOF JOIN h1 ON x1.lang = h1.lang AND x1.u0 <= h1.upto),
h2 AS (SELECT lang, d, e, sum({_binomial('d', 'e', 'p2')}) OVER (PARTITION BY lang, d ORDER BY e) AS upto FROM (SELECT *, unnest(range(0, CASE WHEN p2 <= 0 THEN 1 ELSE d + 1 END)) AS e FROM (SELECT DISTINCT lang, d, p2 FROM d1))),
s AS (SELECT d1.lang, list_sort(list(2 * h2.e - d1.d)) AS a FROM d1 ASOF JOIN h2 ON d1.lang = h2.lang AND d1.d = h2.d AND d1.u1 <= h2.upto GROUP BY d1.lang)"""
_ONE = _COUNTS.replace("SELECT count(*) AS n", "SELECT '' AS lang, count(*) AS n")
_BY_LANG = "k AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND toxic <> 0) AS b, count(*) FILTER (toxic = 0 AND quality <> 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY lang)"


def _rank(col: str, by: str, name: str) -> str:
    return f"rank() OVER ({by} ORDER BY {col}) + (count(*) OVER ({'PARTITION BY ' + col if not by else by + ', ' + col}) - 1) / 2.0::DOUBLE AS {name}"


_PAIRS = ("qe", "qs", "es", "et")


def _p_value(r: str) -> str:
    """Two-sided p of a correlation r of n pairs: the continued fraction of the incomplete beta function, term by term."""
    z, p, q = f"CASE WHEN {r} * {r} > 3 / (n + 3.0::DOUBLE) THEN 1 - {r} * {r} ELSE {r} * {r} END", f"CASE WHEN {r} * {r} > 3 / (n + 3.0::DOUBLE) THEN (n - 2) / 2.0::DOUBLE ELSE 0.5::DOUBLE END", f"CASE WHEN {r} * {r} > 3 / (n + 3.0::DOUBLE) THEN 0.5::DOUBLE ELSE (n - 2) / 2.0::DOUBLE END"
    step = "{'k': k.k, 'p': s.p, 'q': s.q, 'z': s.z, 'c': 1 + N / s.c, 'd': 1 / (1 + N * s.d), 'h': s.h * (1 + N / s.c) / (1 + N * s.d)}"
    even = "(k.k // 2 * (s.q - k.k // 2) * s.z / ((s.p + k.k - 1) * (s.p + k.k)))"
    odd = "(-(s.p + (k.k - 1) // 2) * (s.p + s.q + (k.k - 1) // 2) * s.z / ((s.p + k.k - 1) * (s.p + k.k)))"
    zero = f"{{'k': 0::BIGINT, 'p': {p}, 'q': {q}, 'z': {z}, 'c': 1::DOUBLE, 'd': 1 / (1 - ({p} + {q}) * ({z}) / ({p} + 1)), 'h': 1 / (1 - ({p} + {q}) * ({z}) / ({p} + 1))}}"
    blank = "{'k': m, 'p': 0::DOUBLE, 'q': 0::DOUBLE, 'z': 0::DOUBLE, 'c': 0::DOUBLE, 'd': 0::DOUBLE, 'h': 0::DOUBLE}"
    terms = f"list_transform(range(2, 2002 + 20 * ceil(sqrt(n))::BIGINT), lambda m: {blank})"
    folded = f"list_reduce(list_prepend({zero}, {terms}), lambda s, k: CASE WHEN k.k % 2 = 0 THEN {step.replace('N', even)} ELSE {step.replace('N', odd)} END).h"
    front = f"exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE) - lgamma(0.5::DOUBLE) + (n - 2) / 2.0::DOUBLE * ln(1 - {r} * {r}) + ln(abs({r})))"
    return f"CASE WHEN {r} * {r} > 3 / (n + 3.0::DOUBLE) THEN {front} * {folded} / ((n - 2) / 2.0::DOUBLE) ELSE 1 - {front} * {folded} / 0.5::DOUBLE END"


ORACLES = {
    "mcnemar_by_lang": f"WITH k AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS solved_a, count(*) FILTER (toxic = 0) AS solved_b, count(*) FILTER (quality = 1 AND toxic <> 0) AS b, count(*) FILTER (toxic = 0 AND quality <> 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY lang), q AS (SELECT *, {_P} AS p0 FROM k) SELECT lang, n, solved_a, solved_b, b, c, round(p0, 6) AS p, CASE WHEN p0 < .001 THEN '***' WHEN p0 < .01 THEN '**' WHEN p0 < .05 THEN '*' ELSE 'ns' END AS stars FROM q",
    "test_suite": f"""WITH r AS (SELECT 'line' || l_linenumber AS model, l_orderkey AS idx, bool_or(l_linestatus = 'O') AS solved FROM lineitem GROUP BY 1, 2), s(test, a, b) AS (VALUES {', '.join(map(str, _SPECS))}),
k AS (SELECT s.test, count(*) AS n, count(*) FILTER (x.solved AND NOT y.solved) AS b, count(*) FILTER (y.solved AND NOT x.solved) AS c FROM s JOIN r x ON x.model = s.a JOIN r y ON y.model = s.b AND y.idx = x.idx GROUP BY 1)
SELECT s.test, n, k.b AS b, k.c AS c, CASE WHEN n IS NOT NULL THEN round((SELECT {_P.replace('b + c', 'k.b + k.c').replace('least(b, c)', 'least(k.b, k.c)')}), 6) END AS p, n IS NULL AS skipped FROM s LEFT JOIN k USING (test)""",
    "paired_diff": f"WITH {_COUNTS} SELECT *, c - b AS diff FROM k",
    "bootstrap_ci": f"WITH {_ONE}, {_RESAMPLED} SELECT a[501] AS low, a[19501] AS high FROM s",
    "tost_bound": f"WITH {_ONE}, {_RESAMPLED}, e AS (SELECT a[1000] AS low, a[19000] AS high, n FROM s JOIN k USING (lang)) SELECT *, greatest(abs(low), abs(high)) AS bound, round(100.0::DOUBLE * greatest(abs(low), abs(high)) / n, 6) AS bound_percent, CASE WHEN low > -10 AND high < 10 THEN 'equivalent' ELSE 'not shown' END AS verdict FROM e",
    "pairwise_intervals": f"WITH {_BY_LANG}, {_RESAMPLED} SELECT lang, n, b, c, round({_P}, 6) AS p, a[501] AS low, a[19501] AS high FROM k JOIN s USING (lang)",
    "agreement_rate": "SELECT user_id, round(avg((event_type = 'click')::INT), 6) AS rate FROM events GROUP BY user_id",
    "correlation_suite": f"WITH r AS (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS e, l_discount AS s, l_tax AS t, {_rank('l_quantity', 'PARTITION BY l_returnflag', 'rq')}, {_rank('l_extendedprice', 'PARTITION BY l_returnflag', 're')}, {_rank('l_discount', 'PARTITION BY l_returnflag', 'rs')}, {_rank('l_tax', 'PARTITION BY l_returnflag', 'rt')} FROM lineitem), c AS (SELECT l_returnflag, count(*) AS n, {', '.join(f'corr({a}, {b}) AS pearson_{a}{b}, corr(r{a}, r{b}) AS spearman_{a}{b}' for a, b in _PAIRS)} FROM r GROUP BY l_returnflag) SELECT l_returnflag, {', '.join(f'round({k}_{a}{b}, 6) AS {k}_{a}{b}, round({_p_value(f'{k}_{a}{b}')}, 7) AS p_{k}_{a}{b}' for a, b in _PAIRS for k in ('pearson', 'spearman'))} FROM c",
    "spearman": f"WITH r AS (SELECT {_rank('l_quantity', '', 'rq')}, {_rank('l_extendedprice', '', 're')} FROM lineitem) SELECT round(corr(rq, re), 6) AS rho, count(*) AS n FROM r",
    "nan_statistics": "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linenumber <> 7), 6) AS mean, median(l_quantity) FILTER (l_linenumber <> 7) AS median, count(*) FILTER (l_linenumber = 7) AS skipped FROM lineitem GROUP BY l_returnflag",
    "cache_profile": "WITH o AS (SELECT list_sort(list(n_chars)) AS a, count(*) AS n, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (n_chars >= 3950) AS truncated, max(n_chars) AS longest FROM documents) SELECT n AS total, empty, truncated, longest, a[floor(n * 0.5::DOUBLE)::INT + 1] AS p50, a[floor(n * 0.9::DOUBLE)::INT + 1] AS p90 FROM o",
    "alignment_report": "WITH x AS (SELECT abs(n_chars - 5 * len(string_split(text, ' '))) AS delta FROM documents), o AS (SELECT list_sort(list(delta)) AS a, count(*) AS n, max(delta) AS largest, round(avg((delta > 2)::INT), 6) AS above FROM x) SELECT a[n // 2 + 1] AS median, largest, above FROM o",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "clustered_bootstrap"]}
