import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import source_code, text, tokens, vectors
from tracewell.operators import batching, compare, curate, evaluate, stats
from tracewell.operators.ordering import positions

# Published discordant counts and exact p of the significance suite.
GOLDEN = [
    (3, 17, 0.00257683), (3, 19, 0.000855446), (20, 1, 2.09808e-05), (18, 5, 0.010622), (21, 0, 9.53674e-07), (23, 0, 2.38419e-07), (9, 5, 0.42395),
    (8, 10, 0.814529), (2, 3, 1.0), (2, 1, 1.0), (8, 2, 0.109375), (7, 6, 1.0), (9, 3, 0.145996), (3, 2, 1.0), (3, 6, 0.507812), (26, 0, 2.98023e-08), (2, 2, 1.0), (0, 0, 1.0),
]


def test_mcnemar_golden(spark):
    rows = spark.createDataFrame([(b, c, p) for b, c, p in GOLDEN], "b bigint, c bigint, want double").select("want", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(r["want"], rel=1e-5)


def test_mcnemar_large_counts(spark):
    b, c = 5000, 5200
    n = b + c
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(b + 1)]
    want = min(1.0, 2 * sum(map(math.exp, logs)))
    got = spark.range(1).select(stats.mcnemar(F.lit(b).cast("bigint"), F.lit(c).cast("bigint"))).first()[0]
    assert got == pytest.approx(want, rel=1e-6)


def test_interval_places_keep_both_conventions():
    assert stats.interval_places(20000) == (500, 19500)
    assert stats.interval_places_minus_one(20000, 0.95) == (500, 19499)
    assert stats.interval_places_minus_one(20000, 0.9) == (999, 18999)


def test_pass_at_k_by_enumeration(spark):
    from itertools import combinations

    for n, c, k in [(5, 0, 1), (5, 2, 3), (5, 5, 2), (4, 1, 4), (3, 1, 5)]:
        groups = list(combinations(range(n), k)) or [tuple(range(n))]
        want = sum(any(i < c for i in g) for g in groups) / len(groups) if k <= n else 1.0
        got = spark.range(1).select(evaluate.pass_at_k(F.lit(n).cast("bigint"), F.lit(c).cast("bigint"), k)).first()[0]
        assert got == pytest.approx(want)


def test_zero_tests_are_no_pass(spark):
    rows = spark.createDataFrame([(0, 0), (2, 2), (1, 2), (None, None)], "p int, t int").select(evaluate.fully_passed(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [False, True, False, False]


def test_place_percentiles_match_sorted_list(spark):
    draw = random.Random(3)
    values = [draw.randrange(50) for _ in range(301)]
    got = stats.place_percentiles(spark.createDataFrame([(v,) for v in values], "x int"), "x", {"p50": 0.5, "p90": 0.9, "p100": 1.0}).first()
    ordered = sorted(values)
    assert (got["p50"], got["p90"], got["p100"]) == (ordered[150], ordered[int(301 * 0.9)], ordered[-1])


def test_average_ranks(spark):
    got = stats.average_rank(spark.createDataFrame([(1, x) for x in (3.0, 1.0, 3.0, 2.0, 3.0)], "g int, x double"), ["g"], "x", "r").orderBy("x").select("r").collect()
    assert [r[0] for r in got] == [1.0, 2.0, 4.0, 4.0, 4.0]


def test_correlation_degenerates_to_nan(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 3.0), ("c", 2.0, 2.0), ("c", 3.0, 1.0), ("c", float("nan"), 9.0)], "g string, x double, y double")
    got = {r["g"]: r["c"] for r in rows.groupBy("g").agg(stats.correlation(F.col("x"), F.col("y")).alias("c")).collect()}
    assert math.isnan(got["a"]) and math.isnan(got["b"]) and got["c"] == pytest.approx(-1.0)


def test_roles_and_absent_ones(spark):
    names = spark.createDataFrame([("My-Original",), ("x distilled",), ("TeacherX",), ("other",)], "n string").select(compare.role(F.col("n"))).collect()
    assert [r[0] for r in names] == ["original", "distilled", "teacher", "other"]
    got = compare.compare_roles(spark.createDataFrame([(1, "original", True), (2, "distilled", True), (2, "teacher", True)], "idx int, role string, solved boolean")).orderBy("idx").collect()
    assert (got[0]["regressed"], got[0]["unreachable"], got[1]["gained"]) == (True, True, True)


def test_monotone_upsert_keeps_passes(spark):
    old = spark.createDataFrame([(1, True, "old"), (2, False, "old"), (3, None, "old")], "idx int, passed boolean, v string")
    new = spark.createDataFrame([(1, False, "new"), (2, False, "new"), (3, True, "new"), (4, False, "new")], "idx int, passed boolean, v string")
    got = {r["idx"]: r["v"] for r in curate.monotone_upsert(old, new, "idx", "passed").collect()}
    assert got == {1: "old", 2: "new", 3: "new", 4: "new"}


def test_budget_packing_admits_an_oversized_item_alone(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([50, 500, 10, 10, 10, 10])], "g string, i bigint, n bigint")
    got = batching.pack_by_budget(rows, "g", "i", "n", 3, 100).orderBy("i").collect()
    assert [r["batch"] for r in got] == [0, 1, 2, 2, 2, 3]


def test_budget_packing_across_blocks(spark):
    draw = random.Random(7)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(200), draw.choice([1, 2, 5, 9, 40, None])) for _ in range(400)]
    want, last = [], None
    for g, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is not None, r[2] or 0)):
        if g != last or not want:
            last, batch, count, longest = g, 0, 0, 0
        if count and (count + 1 > 4 or max(longest, n or 0) * (count + 1) > 30):
            batch, count, longest = batch + 1, 0, 0
        count, longest = count + 1, max(longest, n or 0)
        want.append((g, i, n, batch))
    df = spark.createDataFrame(rows, "g string, i int, n int")
    for block in (1, 30, 1000):
        got = [tuple(r) for r in batching.pack_by_budget(df, "g", "i", "n", 4, 30, block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), block
    assert batching.pack_by_budget(df.limit(0), "g", "i", "n", 4, 30).count() == 0


def test_retry_once_keeps_what_fails_twice(spark):
    attempt = lambda df, k: df.withColumn("ok", F.when(F.col("x") != 4, F.col("x") <= 2 * k)).withColumn("x", F.when(F.col("ok"), F.col("x") + 10).otherwise(F.col("x")))
    got = evaluate.retry_once(spark.createDataFrame([(0,), (1,), (3,), (4,), (None,)], "x int"), attempt, lambda df: df).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(10, 1, False), (11, 2, False), (3, 2, True), (4, 2, True), (None, 2, True)], key=str)


def test_causes_of_unsolved_samples(spark):
    rows = [(1, 0, False, "b", True), (1, 1, False, "b", None), (1, 2, False, "a", True), (2, 0, True, "a", True), (3, 0, False, "", False), (3, 1, True, None, None)]
    df = spark.createDataFrame(rows, "idx int, j int, solved boolean, category string, cut boolean")
    got = {r["idx"]: (r["solved"], r["unsolved"], r["truncated"], r["cause"]) for r in evaluate.diagnose(df, F.col("cut")).collect()}
    assert got == {1: (False, 3, 2, "b"), 2: (True, 0, 1, None), 3: (True, 1, 0, None)}
    assert {r["idx"]: r["any_truncated"] for r in evaluate.representative(df, F.col("cut")).collect()} == {1: True, 2: True, 3: False}


def test_text_functions(spark):
    rows = spark.createDataFrame([("<think>a</think>\n b",), ("plain",), ("```py\nx\t= 1\n``` end",), ("hi\ndef f(x):\n    return x\n\nbye\n  indented\n@mention",), ("x ```python x = 1",), ("```\nintro\ndef g():\n\treturn 1\n```",)], "t string")
    got = rows.select(text.strip_thinking(F.col("t")).alias("s"), text.fenced_code(F.col("t")).alias("f"), text.unfenced_code(F.col("t")).alias("u")).collect()
    assert [r["s"] for r in got][:2] == ["b", "plain"]
    assert got[2]["f"] == "x    = 1\n" and got[1]["f"] is None
    assert got[3]["u"] == "def f(x):\n    return x" and got[1]["u"] == ""
    assert got[4]["f"] == "x = 1"
    assert [r[0] for r in rows.select(text.code_of(F.col("t"))).collect()][2:] == ["x    = 1", "def f(x):\n    return x", "x = 1", "def g():\n    return 1"]
    errors = [("fail", "AssertionError: NameError: x is not defined"), ("fail", "ValueError: timeout must be positive"), ("fail", "NameError: free"), ("fail", "NameError: name 'f' is not defined"), ("timeout", "SyntaxError"), ("pass", "x"), ("fail", None), ("fail", "AssertionError in SyntaxError")]
    kinds = spark.createDataFrame(errors, "s string, e string").select(text.outcome(F.col("s"), F.col("e"))).collect()
    assert [r[0] for r in kinds] == ["wrong_answer", "runtime_error", "runtime_error", "missing_function", "timeout", "pass", "runtime_error", "syntax_error"]


def test_shingle_ratio_leaves_the_last_out(spark):
    texts = ["ab" * 40, "short", "".join(chr(97 + i % 26) + str(i) for i in range(60))]

    def want(t):
        return 1.0 if len(t) < 48 else len({t[i : i + 24] for i in range(len(t) - 24)}) / (len(t) - 24)

    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.shingle_ratio(F.col("t"))).collect()
    assert [r[0] for r in got] == pytest.approx([want(t) for t in texts])


def test_source_code_tools():
    c = source_code
    assert c.largest_prefix("x = 1\ny = (\n") == "x = 1"
    assert c.largest_prefix("") == ""
    assert "def add(a):" in c.unwrap("class Solution:\n    def add(self, a):\n        return self.add(a)") and "self" not in c.unwrap("class Solution:\n    def add(self, a):\n        return self.add(a)")
    cases = c.split_tests("import math\n\ndef near(a):\n    return a\n\ndef check(candidate):\n    y = math.pi\n    assert near(candidate(2)) == 3", "f")
    assert cases == [f"import math\ndef near(a):\n    return a\ndef check(candidate):\n    {x}\ncheck(f)" for x in ("y = math.pi", "assert near(candidate(2)) == 3")]
    assert c.split_tests("x = 1", "f") == c.split_tests("def check(", "f") == c.split_tests(" ", "f") == []
    assert c.call_signature("assert candidate(1) == candidate(nums, 2, k=3)\ncandidate(a, b)", "f") == "def f(nums, arg1, k):"
    assert c.call_signature("assert f(1)", "f") == c.call_signature("candidate()", "f") == ""
    assert c.largest_prefix("x = 1  \n\n") == "x = 1" and c.largest_prefix("a = 1\nb = \0") == "a = 1" and c.largest_prefix("(" * 100_000) == ""
    whole = c.unwrap("import re\nclass Solution:\n    K: int = 3\n    def __init__(self):\n        pass\n    async def go(self):\n        return self.K\n    def f(self, x):\n        return x + self.K\nbroken (")
    space = {}
    exec(whole, space)
    assert space["f"](1) == 4 and "async def go()" in whole and "import re" in whole and "self" not in whole and "__init__" not in whole
    assert c.unwrap("x = (\n") == "" and c.unwrap("def f(): pass\n") == "def f(): pass"
    assert c.definition_signature("def g(a, b=2): pass", "f") == "def g(a, b=2):"
    assert c.meant("def addTwo(a): return helper(a)\ndef helper(a): return a", "add_two") == "addTwo"
    assert c.meant("def one(a): return two(a)\ndef two(a): return a", "zzz") == "one"
    assert c.alias("async def addTwo(a): pass", "add_two") == "async def addTwo(a): pass\nadd_two = addTwo\n"
    assert c.alias("def f(): pass", "f") == c.alias("def f(): pass", "") == "def f(): pass" and c.alias("x = (", "f") == "x = ("


def test_rounding_is_half_to_even(spark):
    got = spark.range(1).select(vectors.quantize(F.array(*map(F.lit, [7.0, 0.5, 1.5, 2.5, -0.5])), 4)).first()[0]
    assert [x + 0.0 for x in got] == [7.0, 0.0, 2.0, 2.0, 0.0]


def test_group_that_does_not_divide_is_left_alone(spark):
    a = F.array(*map(F.lit, [0.3, 0.2, 0.1]))
    assert spark.range(1).select(vectors.quantize(a, 4, 2)).first()[0] == [0.3, 0.2, 0.1]
    assert math.isnan(spark.range(1).select(vectors.nmse(F.array(F.lit(0.0)), F.array(F.lit(0.0)))).first()[0])


def test_steps_shrink_with_bits_and_groups(spark):
    draw = random.Random(1)
    w = F.array(*[F.lit(draw.gauss(0, 1)) for _ in range(64)])
    row = spark.range(1).select(*[vectors.mean(vectors.steps(w, b, 16)).alias(f"b{b}") for b in (3, 4, 8)], *[vectors.mean(vectors.steps(w, 4, g)).alias(f"g{g}") for g in (8, 16, 64)]).first()
    assert row["b3"] > row["b4"] > row["b8"] and row["g8"] <= row["g16"] <= row["g64"]


def test_distributions(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    peaked, flat, empty = ([0.97, 0.01, 0.01, 0.01], [0.25] * 4, [0.0] * 4)
    arr = lambda p: F.array(*map(F.lit, p))
    assert one(tokens.entropy_focus(arr(empty))) == 0 and one(tokens.confidence(arr(empty))) == 0
    assert one(tokens.entropy_focus(arr(flat))) == pytest.approx(1.0) and one(tokens.entropy_focus(arr([1.0, 0.0]))) == pytest.approx(0.3)
    assert one(tokens.confidence(arr(peaked))) > one(tokens.confidence(arr(flat)))
    assert one(tokens.effective_k(arr(flat))) == pytest.approx(4.0)
    assert one(tokens.skew_kl(arr(flat), arr(flat), 0.9)) == pytest.approx(0.0, abs=1e-12) and one(tokens.kl(arr(peaked), arr(flat))) > 0
    entries = F.array(*[F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(v).alias("logprob")) for i, v in [(1, -1.0), (2, -2.0), (1, -1.0), (99, 0.0)]])
    got = one(tokens.normalize_top_k(entries, 3, 1.0, 50))
    assert [x["id"] for x in got] == [1, 2, 0] and sum(x["p"] for x in got) == pytest.approx(1.0)


def test_positions_over_many_partitions(spark):
    draw = random.Random(8)
    rows = [(draw.choice([1, 1, 1, 5, 9]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(17)
    got = [(r["a"], r["b"]) for r in sorted(positions(df, ["a", "b"]).collect(), key=lambda r: r["place"])]
    assert got == sorted(rows)
    assert sorted(r["place"] for r in positions(df, ["a", "b"]).collect()) == list(range(3000))
    assert positions(df.where("false"), ["a", "b"]).count() == 0


def test_every_assert_of_a_suite_reports(capsys):
    suite = "def near(a, b):\n    return abs(a - b) < 1\n\ndef check(candidate):\n    y = 2\n    assert candidate(y, [1]) == 3\n    for z in (1,):\n        assert near(candidate(z, 5), 9)\n        assert candidate(z, 0) > 0"
    out = source_code.report(suite)
    assert "assert " not in out and source_code.report("not python (") == "not python ("

    def run(candidate):
        space = {}
        exec(out, space)
        try:
            space["check"](candidate)
        except AssertionError as e:
            return str(e), capsys.readouterr().out
        return None, capsys.readouterr().out

    assert run(lambda a, b: 0) == ("candidate(y, [1]) == 3", "  Input:    y, [1]\n  Output:   0\n  Expected: 3\n")
    assert run(lambda a, b: 3 if b == [1] else 0) == ("near(candidate(z, 5), 9)", "  Input:    z, 5\n  Output:   0\n  Expected: 9\n")
    assert run(lambda a, b: {5: 9, 0: 0}.get(b, 3) if b != [1] else 3) == ("candidate(z, 0) > 0", "  Failed:   candidate(z, 0) > 0\n")
    assert run(lambda a, b: 3 if b == [1] else 9) == (None, "")


def test_code_tools_instruments_asserts_inside_check(spark, sf_dir):
    from tracewell.plans import texts

    row = texts.code_tools(spark, sf_dir).where("doc_id = 2").first()
    assert "assert " not in row["instrumented"] and "Input:" in row["instrumented"]


def test_resamples_follow_the_exact_distribution(spark):
    """Interval ends of 20,000 resamples against quantiles of the exact distribution of the resampled sum."""
    n, b, c, iters = 60, 9, 17, 20_000
    single, exact = np.array([b, n - b - c, c]) / n, np.array([1.0])
    for _ in range(n):
        exact = np.convolve(exact, single)
    below = np.cumsum(exact)
    places = {"low": 500, "high": 19_500}
    assert stats.interval_places(iters) == (500, 19_500) and stats.interval_places_minus_one(iters, 0.95) == (500, 19_499)
    counts = spark.createDataFrame([(n, b, c)], "n long, b long, c long")
    row = stats.order_statistics(stats.bootstrap_sums(counts, iters), "total", places).first()
    again = stats.order_statistics(stats.bootstrap_sums(counts, iters), "total", places).first()
    other = stats.grouped_intervals(counts, ["n", "b", "c"], iters, places).first()
    for got in (row, other):
        for name, q in (("low", 0.025), ("high", 0.975)):
            want = int(np.searchsorted(below, q)) - n
            assert abs(got[name] - want) <= 1
    assert row == again
    none = stats.bootstrap_sums(spark.createDataFrame([(0, 0, 0)], "n long, b long, c long"), 10).collect()
    assert [r["total"] for r in none] == [0] * 10


@pytest.mark.parametrize("n, p", [(1, 0.3), (40, 0.02), (300, 0.5), (2_000, 0.999)])
def test_binomial_quantiles_by_enumeration(n, p):
    upto = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]) if n < 1000 else None
    u = np.random.default_rng(n).random(500)
    got = stats.binomial_quantiles(u, n, p)
    if upto is not None:
        assert (got == np.searchsorted(upto, u)).all()
    assert (np.diff(stats.binomial_quantiles(np.sort(u), n, p)) >= 0).all() and got.mean() == pytest.approx(n * p, abs=5 * math.sqrt(n * p * (1 - p) / 500))
    assert list(stats.binomial_quantiles(u[:2], n, 0.0)) == [0, 0] and list(stats.binomial_quantiles(u[:2], n, 1.0)) == [n, n]


def test_resamples_of_many_pairs():
    """A billion pairs: normal to the precision of 20,000 resamples, in the work of a few million terms."""
    n, b, c = 10**9, 3 * 10**5, 4 * 10**5
    sums = stats.resampled_sums(stats.uniforms(list(range(20_000)), 7), n, b, c)
    assert sums.mean() == pytest.approx(c - b, abs=30) and sums.std() == pytest.approx(math.sqrt(b + c), rel=0.02)


def test_clustered_resamples(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=400)
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    means = np.array([r["mean"] for r in stats.clustered_bootstrap_means(rows, "x", 3000).collect()])
    assert len(means) == 3000 and means.mean() == pytest.approx(x.mean(), abs=0.01) and means.std() == pytest.approx(x.std() / 20, rel=0.08)


def test_mcnemar_of_large_counts(spark):
    pairs = [(0, 0), (0, 5), (3, 9), (40, 60), (500_000, 501_500), (10**9, 10**9 + 150_000), (7, 10**7)]
    got = [r[0] for r in spark.createDataFrame(pairs, "b bigint, c bigint").select(stats.mcnemar(F.col("b"), F.col("c"))).collect()]
    for (b, c), p in zip(pairs, got):
        n, m = b + c, min(b, c)
        if n < 10**6:
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n)
        else:  # with the correction for continuity the normal approximation is exact enough here
            want = min(1.0, math.erfc((abs(b - c) - 1) / math.sqrt(2 * n)))
        assert p == pytest.approx(want, rel=1e-3, abs=1e-12), (b, c)


def test_p_values_of_correlations(spark):
    """Against I_x(1, b) = 1 - (1 - x)^b, I_x(a, 1) = x^a, symmetry, published quantiles of t, and numerical integration."""
    rows = spark.createDataFrame([(x, a, b) for x in (0.0, 1e-9, 0.2, 0.5, 0.93, 1.0) for a, b in ((1.0, 3.5), (2.5, 1.0), (0.5, 0.5), (30000.0, 0.5), (7.0, 90.0))], "x double, a double, b double")
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    for r in rows.select("*", stats.incomplete_beta(x, a, b).alias("i"), stats.incomplete_beta(1.0 - x, b, a).alias("j")).collect():
        assert r["i"] + r["j"] == pytest.approx(1.0, abs=1e-9)
        if r["a"] == 1.0:
            assert r["i"] == pytest.approx(1 - (1 - r["x"]) ** r["b"], abs=1e-9)
        if r["b"] == 1.0:
            assert r["i"] == pytest.approx(r["x"] ** r["a"], abs=1e-9)
        if r["a"] == r["b"] == 0.5:
            assert r["i"] == pytest.approx(2 / math.pi * math.asin(math.sqrt(r["x"])), abs=1e-9)

    def by_integral(t, df, n=200_000):
        """Two-sided p of t by Simpson's rule, to 1e-12 at these sizes."""
        u = np.linspace(0, t, n + 1)
        y = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(u * u / df))
        return 1 - 2 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * t / n / 3

    cases = [(0.1, 20), (-0.63, 12), (0.5, 5), (0.02, 10_000), (0.9, 4), (0.003, 60_000)]
    got = spark.createDataFrame(cases, "r double, n long").select("r", "n", stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for r in got:
        df = r["n"] - 2
        assert r["p"] == pytest.approx(by_integral(abs(r["r"]) * math.sqrt(df / (1 - r["r"] ** 2)), df), abs=1e-8)
    t = 2.228138851964939  # the 97.5 % quantile of t with 10 degrees of freedom
    edge = spark.createDataFrame([(t / math.sqrt(10 + t * t), 12), (1.0, 9), (-1.0, 9), (0.0, 9), (float("nan"), 9), (0.5, 2)], "r double, n long")
    p = [r[0] for r in edge.select(stats.correlation_p(F.col("r"), F.col("n"))).collect()]
    assert p[0] == pytest.approx(0.05, abs=1e-9) and p[1] == p[2] == 0 and p[3] == 1 and math.isnan(p[4]) and math.isnan(p[5])


def test_recovery_goes_on_where_it_was_stopped(spark, tmp_path):
    failed, calls = spark.range(12).withColumnRenamed("id", "idx"), []

    def work(name, broken=False):
        def one(problems, attempt):
            calls.append((name, attempt, sorted(r["idx"] for r in problems.collect())))
            if broken and attempt == 2:
                raise RuntimeError("stopped")
            known = problems.where("idx <> 11")  # of one there is no outcome, of another a null one
            return known.select("idx", F.when(F.col("idx") == 10, None).otherwise(F.col("idx") % 4 == attempt + (1 if name == "b" else -1)).alias("solved"))

        return one

    folder = str(tmp_path / "r")
    with pytest.raises(RuntimeError):
        evaluate.recover(failed, [("a", 1, work("a")), ("b", 2, work("b", True))], folder)
    assert [c[:2] for c in calls] == [("a", 1), ("b", 1), ("b", 2)] and calls[1][2] == [i for i in range(12) if i % 4 or i == 11]
    calls.clear()
    got = {r["idx"]: (r["stage"], r["attempt"], r["solved"]) for r in evaluate.recover(failed, [("a", 1, work("a")), ("b", 2, work("b"))], folder).collect()}
    assert [c[:2] for c in calls] == [("b", 2)] and len(got) == 12
    assert all(got[i] == {0: ("a", 1, True), 2: ("b", 1, True), 3: ("b", 2, True), 1: ("b", 2, False)}[i % 4] for i in range(10)) and got[10] == got[11] == ("b", 2, False)


def test_quantiles_of_many_distinct_values(spark):
    """Ten million distinct values, by no window over all of them."""
    n = 10_000_000
    rows = spark.range(n).select(((F.col("id") * 7_368_787) % n).cast("double").alias("x"), (F.col("id") % 2).alias("g"))
    df = stats.place_percentiles(rows, "x", {"p10": 0.1, "p50": 0.5, "p100": 1.0})
    assert tuple(df.first()) == (n * 0.1, n * 0.5, n - 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_part" in line or "_sum" in line for line in windows)  # inside sorted partitions, or over a row for each of them
    few = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, None), (1, float("nan")), (2, 5.0), (2, 7.0), (2, 7.0), (3, None)], "g int, x double")
    assert {r["g"]: r["median"] for r in stats.medians(few, ["g"], "x").collect()} == {1: 2.0, 2: 7.0}
    assert stats.place_percentiles(few.where("false"), "x", {"a": 0.5}).first()["a"] is None


def test_results_of_source_functions_go_to_arrow_by_pieces(spark):
    """Few results are Python objects at a time, and nulls, empty batches and lists come through."""
    import weakref

    from tracewell.functions import source_code

    class Text(str):
        pass

    alive, most = weakref.WeakSet(), []

    def results():
        for i in range(3000):
            x = Text(i)
            x.key = i
            alive.add(x)
            most.append(len(alive))
            yield x

    made = source_code._made(results(), "string")
    assert made.to_pylist() == [str(i) for i in range(3000)] and max(most) <= 2 * source_code.PIECE + 2
    assert source_code._made(iter([None, ["a"], []]), "array<string>").to_pylist() == [None, ["a"], []] and len(source_code._made(iter([]), "string")) == 0
