"""Evaluation queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import compare, evaluate
from tracewell.plans.tables import PROBLEMS_SQL, SAMPLES_SQL, problems, samples, table

CATEGORIES = ["pass", "click", "error", "purchase", "missing_function"]
_FOLD = """folded AS (SELECT idx, count(*) AS num_samples, count(*) FILTER (solved) AS num_passing, bool_or(solved) AS solved,
  arg_min(passed, j) AS passed, arg_min(total, j) AS total, arg_min(category, j) AS category FROM samples GROUP BY idx)"""
_KEY = "CASE WHEN lower(trim(coalesce(difficulty, ''))) = '' THEN 'unknown' ELSE lower(trim(difficulty)) END"


def _passk(k: int) -> str:
    return f"CASE WHEN num_samples - num_passing < {k} THEN 1.0 ELSE 1 - coalesce(list_product(list_transform(range(num_samples - num_passing + 1, num_samples + 1), lambda i: 1 - {k}.0::DOUBLE / i)), 1.0) END"


def pass_at_k(spark, d):
    n, c = F.col("num_samples"), F.col("num_passing")
    folded = evaluate.fold_samples(samples(spark, d))
    return folded.select("idx", "num_samples", "num_passing", *[F.round(evaluate.pass_at_k(n, c, k), 6).alias(f"pass_at_{k}") for k in (1, 2, 5)])


def eval_rollup(spark, d):
    """Validation-set totals: tests passed, problems solved, guarded rates."""
    rows = evaluate.fold_samples(samples(spark, d))
    return rows.agg(
        F.sum("passed").alias("total_passed"), F.sum("total").alias("total_tests"), F.count_if("solved").alias("problems_solved"), F.count("*").alias("num_problems"),
        F.round(evaluate.ratio(F.sum("passed"), F.sum("total")), 6).alias("test_pass_rate"), F.round(evaluate.ratio(F.count_if("solved"), F.count("*")), 6).alias("solve_rate"),
    )


def difficulty_breakdown(spark, d):
    rows = problems(spark, d).join(evaluate.fold_samples(samples(spark, d)), "idx")
    out = evaluate.by_difficulty(rows, 2)
    rates = [F.round(c, 6).alias(c) for c in ("test_pass_rate", "pass_at_1", "pass_at_k")]
    return out.select("difficulty", "num_problems", "solved", *rates, evaluate.difficulty_rank(F.col("difficulty")).cast("int").alias("place")).orderBy("place", "difficulty")


def failure_counts(spark, d):
    return evaluate.failure_counts(table(spark, d, "events"), "event_type", CATEGORIES)


def dominant_cause(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("cause"))
    return evaluate.dominant(rows, "user_id", "cause", "event_id", "unknown")


def any_vs_dominant_hist(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("cause"))
    dom = evaluate.dominant(rows, "user_id", "cause", "event_id", "pass").groupBy("cause").agg(F.count("*").alias("dominant"))
    some = rows.select("user_id", "cause").distinct().groupBy("cause").agg(F.count("*").alias("any"))
    return some.join(dom, "cause", "left").select("cause", "any", F.coalesce("dominant", F.lit(0)).alias("dominant"))


def nested_cause_counts(spark, d):
    """difficulty -> cause -> count as one JSON-like text per difficulty, causes by count and name."""
    rows = problems(spark, d).join(samples(spark, d).where("not solved"), "idx").groupBy(evaluate.normal_difficulty(F.col("difficulty")).alias("difficulty"), "category").count()
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("m"), "category", "count")))
    return rows.groupBy("difficulty").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["category"], F.lit("="), x["count"].cast("string"))), ",").alias("causes"), F.sum("count").alias("n"))


def difficulty_pass_percent(spark, d):
    """Pass and fail by difficulty with integer percent and sorted causes."""
    rows = problems(spark, d).join(evaluate.fold_samples(samples(spark, d)), "idx").withColumn("difficulty", evaluate.normal_difficulty(F.col("difficulty")))
    out = rows.groupBy("difficulty").agg(F.count_if("solved").alias("ok"), F.count_if(~F.col("solved")).alias("bad"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("solved"), F.col("category")))), ",").alias("causes"))
    return out.withColumn("percent", F.expr("ok * 100 div (ok + bad)"))


def broken_references(spark, d):
    """Problems whose reference fails, or that have no tests: sorted distinct causes."""
    rows = problems(spark, d).join(samples(spark, d), "idx", "left")
    ok = evaluate.fully_passed(F.col("passed"), F.col("total"))
    out = rows.groupBy("idx").agg(F.sum(F.coalesce("passed", F.lit(0))).alias("passed"), F.sum(F.coalesce("total", F.lit(0))).alias("total"), F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.col("category")))), ",").alias("causes"))
    return out.where(~evaluate.fully_passed(F.col("passed"), F.col("total")))


def first_success(spark, d):
    return evaluate.first_success(samples(spark, d))


def best_candidate(spark, d):
    return evaluate.best_candidate(samples(spark, d))


def retry_rounds(spark, d):
    return evaluate.retry_rounds(samples(spark, d))


def timeout_abort(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    out = evaluate.abort_after(rows, "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view"), 3)
    return out.select("event_id", F.when(F.col("aborted"), "timeout").otherwise(F.col("event_type")).alias("outcome"), "aborted")


def distinct_failures(spark, d):
    rows = table(spark, d, "events").where("event_type in ('error', 'view')")
    return evaluate.distinct_failures(rows, "user_id", "event_type", F.concat(F.lit(" at  "), F.col("props")), "event_id", 3)


def problem_diagnosis(spark, d):
    """Cause, truncations and the length of the code that stands for the problem: of its first unsolved sample, or its first."""
    return evaluate.diagnose(samples(spark, d), F.col("total") >= 45, F.repeat(F.lit("x"), F.col("total").cast("int")))


def representative_sample(spark, d):
    return evaluate.representative(samples(spark, d), F.col("total") >= 45)


def recovery_tally(spark, d):
    first = samples(spark, d).where("j = 0").join(problems(spark, d), "idx")
    later = samples(spark, d).where("j > 0").groupBy("idx").agg(F.bool_or("solved").alias("solved"))
    return evaluate.recovery(first.withColumn("difficulty", evaluate.normal_difficulty(F.col("difficulty"))), later, "difficulty")


def rescore_tally(spark, d):
    """Done and passing per difficulty over existing plus new rows, with integer percent."""
    old = samples(spark, d).where("j = 0").select("idx", "solved")
    new = samples(spark, d).where("j = 1").select("idx", "solved")
    rows = old.unionByName(new).join(problems(spark, d), "idx", "left").withColumn("difficulty", F.coalesce(evaluate.normal_difficulty(F.col("difficulty")), F.lit("?")))
    return rows.groupBy("difficulty").agg(F.count("*").alias("done"), F.count_if("solved").alias("passing")).withColumn("percent", F.expr("passing * 100 div done"))


def drop_failed(spark, d):
    """Predicate delete: only fully passed rows stay."""
    rows = samples(spark, d).withColumn("total", F.when(F.col("category") != "timeout", F.col("total")))
    return rows.where(evaluate.fully_passed(F.col("passed"), F.col("total"))).groupBy("category").agg(F.count("*").alias("n"), F.sum("passed").alias("passed"))


def _roles(spark, d):
    names = F.when(F.col("l_linenumber") == 1, "Original 1.5B").when(F.col("l_linenumber") == 2, "x-distilled").otherwise("Teacher 7B")
    rows = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("idx"), compare.role(names).alias("role"), (F.col("l_linestatus") == "O").alias("solved"))
    return rows


def compare_roles(spark, d):
    return compare.compare_roles(_roles(spark, d))


def comparison_summary(spark, d):
    return compare.comparison_counts(compare.compare_roles(_roles(spark, d)))


def comparison_ids(spark, d):
    return compare.comparison_ids(compare.compare_roles(_roles(spark, d)))


def truncation_by_role(spark, d):
    rows = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("idx"), F.when(F.col("l_linenumber") == 1, "original").when(F.col("l_linenumber") == 2, "distilled").otherwise("teacher").alias("role"), (F.col("l_quantity") >= 45).alias("truncated"))
    per = rows.groupBy("role", "idx").agg(F.count_if("truncated").alias("t"))
    return per.groupBy("role").agg(F.sum("t").alias("samples"), F.count_if(F.col("t") > 0).alias("problems"))


def outcome_matrix(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("idx"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"), (F.col("l_linestatus") == "O").alias("solved"))
    return compare.outcome_matrix(rows, [f"m{i}" for i in range(1, 8)])


def verified_subset(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    kept = compare.subset(docs, "doc_id", labels.where("quality = 1"), labels.where("toxic = 1"))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_ROLES_SQL = """r AS (SELECT l_orderkey AS idx, CASE l_linenumber WHEN 1 THEN 'original' WHEN 2 THEN 'distilled' ELSE 'teacher' END AS role, l_linestatus = 'O' AS solved FROM lineitem WHERE l_linenumber <= 3),
w AS (SELECT idx, coalesce(bool_or(solved) FILTER (role = 'original'), false) AS original, coalesce(bool_or(solved) FILTER (role = 'distilled'), false) AS distilled, coalesce(bool_or(solved) FILTER (role = 'teacher'), false) AS teacher FROM r GROUP BY idx),
c AS (SELECT *, distilled AND NOT original AS gained, original AND NOT distilled AS regressed, NOT teacher AND NOT distilled AS unreachable, teacher AND NOT distilled AS reachable_miss FROM w)"""

ORACLES = {
    "pass_at_k": f"WITH {SAMPLES_SQL}, {_FOLD} SELECT idx, num_samples, num_passing, round({_passk(1)}, 6) AS pass_at_1, round({_passk(2)}, 6) AS pass_at_2, round({_passk(5)}, 6) AS pass_at_5 FROM folded",
    "eval_rollup": f"WITH {SAMPLES_SQL}, {_FOLD} SELECT sum(passed)::BIGINT AS total_passed, sum(total)::BIGINT AS total_tests, count(*) FILTER (solved) AS problems_solved, count(*) AS num_problems, round(sum(passed)::DOUBLE / greatest(sum(total), 1), 6) AS test_pass_rate, round((count(*) FILTER (solved))::DOUBLE / greatest(count(*), 1), 6) AS solve_rate FROM folded",
    "difficulty_breakdown": f"""WITH {SAMPLES_SQL}, {_FOLD}, {PROBLEMS_SQL}, x AS (SELECT {_KEY} AS difficulty, f.* FROM problems JOIN folded f USING (idx))
SELECT difficulty, count(*) AS num_problems, count(*) FILTER (solved) AS solved, round(sum(passed)::DOUBLE / greatest(sum(total), 1), 6) AS test_pass_rate, round(avg({_passk(1)}), 6) AS pass_at_1, round(avg({_passk(2)}), 6) AS pass_at_k,
CASE difficulty WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 WHEN 'hard' THEN 2 ELSE 3 END AS place FROM x GROUP BY difficulty""",
    "failure_counts": "SELECT c AS category, (SELECT count(*) FROM events WHERE event_type = c) AS n FROM (VALUES ('pass'), ('click'), ('error'), ('purchase'), ('missing_function')) v(c)",
    "dominant_cause": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN event_type END AS cause FROM events), c AS (SELECT user_id, cause, count(cause) AS n, min(event_id) AS f FROM e GROUP BY user_id, cause),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) SELECT user_id, CASE WHEN n > 0 THEN cause ELSE 'unknown' END AS cause, n FROM r WHERE k = 1""",
    "any_vs_dominant_hist": """WITH c AS (SELECT user_id, event_type AS cause, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c)
SELECT cause, count(*) AS "any", count(*) FILTER (k = 1) AS dominant FROM r GROUP BY cause""",
    "nested_cause_counts": f"WITH {SAMPLES_SQL}, {PROBLEMS_SQL}, x AS (SELECT {_KEY} AS difficulty, category, count(*) AS n FROM problems JOIN samples USING (idx) WHERE NOT solved GROUP BY 1, 2) SELECT difficulty, string_agg(category || '=' || n, ',' ORDER BY n DESC, category) AS causes, sum(n)::BIGINT AS n FROM x GROUP BY difficulty",
    "difficulty_pass_percent": f"WITH {SAMPLES_SQL}, {_FOLD}, {PROBLEMS_SQL}, x AS (SELECT {_KEY} AS difficulty, f.* FROM problems JOIN folded f USING (idx)) SELECT difficulty, count(*) FILTER (solved) AS ok, count(*) FILTER (NOT solved) AS bad, coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (NOT solved)), ','), '') AS causes, (count(*) FILTER (solved)) * 100 // count(*) AS percent FROM x GROUP BY difficulty",
    "broken_references": f"WITH {SAMPLES_SQL}, x AS (SELECT o_orderkey AS idx, coalesce(sum(passed), 0)::BIGINT AS passed, coalesce(sum(total), 0)::BIGINT AS total, coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (NOT coalesce(total > 0 AND passed = total, false) AND category IS NOT NULL)), ','), '') AS causes FROM orders LEFT JOIN samples ON o_orderkey = idx GROUP BY o_orderkey) SELECT * FROM x WHERE NOT (total > 0 AND passed = total)",
    "first_success": f"WITH {SAMPLES_SQL} SELECT idx, min(j) AS j FROM samples WHERE solved GROUP BY idx",
    "best_candidate": f"WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY passed DESC, j) AS k, first_value(passed) OVER (PARTITION BY idx ORDER BY j) AS s FROM samples) SELECT idx, j, passed, passed > s AS replaces FROM r WHERE k = 1",
    "retry_rounds": f"WITH {SAMPLES_SQL}, w AS (SELECT idx, min(j) AS won FROM samples WHERE solved GROUP BY idx) SELECT j AS round, count(*) AS attempts, count(*) FILTER (j = won) AS newly_solved FROM samples LEFT JOIN w USING (idx) WHERE won IS NULL OR j <= won GROUP BY j",
    "timeout_abort": """WITH a AS (SELECT *, event_type IN ('error', 'view') AS bad FROM events), b AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM b), e AS (SELECT *, coalesce(max(streak) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3, false) AS aborted FROM c)
SELECT event_id, CASE WHEN aborted THEN 'timeout' ELSE event_type END AS outcome, aborted FROM e""",
    "distinct_failures": r"""WITH a AS (SELECT user_id, event_type, substr(trim(regexp_replace(' at  ' || props, '\s+', ' ', 'g')), 1, 160) AS error, min(event_id) AS f FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f, event_type, error) AS INTEGER) AS nth FROM a) SELECT user_id, nth, event_type, error FROM r WHERE nth <= 3""",
    "problem_diagnosis": f"""WITH {SAMPLES_SQL}, c AS (SELECT idx, cause, count(*) AS n FROM (SELECT idx, category AS cause FROM samples WHERE NOT solved UNION ALL SELECT idx, 'truncated' FROM samples WHERE NOT solved AND total >= 45) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY n DESC, cause) AS k FROM c), s AS (SELECT idx, bool_or(solved) AS solved, count(*) FILTER (NOT solved) AS unsolved, count(*) FILTER (total >= 45) AS truncated, arg_min(total, CASE WHEN solved THEN 1000000 ELSE 0 END + j)::INT AS code_length FROM samples GROUP BY idx)
SELECT s.*, r.cause FROM s LEFT JOIN r ON s.idx = r.idx AND k = 1""",
    "representative_sample": f"WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY solved, j) AS k, bool_or(total >= 45) OVER (PARTITION BY idx) AS any_truncated FROM samples) SELECT idx, j, category, solved, any_truncated FROM r WHERE k = 1",
    "recovery_tally": f"WITH {SAMPLES_SQL}, {PROBLEMS_SQL}, f AS (SELECT {_KEY} AS difficulty, s.idx FROM samples s JOIN problems USING (idx) WHERE j = 0 AND NOT solved), l AS (SELECT idx, bool_or(solved) AS now FROM samples WHERE j > 0 GROUP BY idx) SELECT difficulty, count(*) AS failed, count(*) FILTER (coalesce(now, false)) AS recovered, (count(*) FILTER (coalesce(now, false))) * 100 // count(*) AS percent FROM f LEFT JOIN l USING (idx) GROUP BY difficulty",
    "rescore_tally": f"WITH {SAMPLES_SQL}, {PROBLEMS_SQL} SELECT {_KEY} AS difficulty, count(*) AS done, count(*) FILTER (solved) AS passing, (count(*) FILTER (solved)) * 100 // count(*) AS percent FROM samples LEFT JOIN problems USING (idx) WHERE j <= 1 GROUP BY 1",
    "drop_failed": f"WITH {SAMPLES_SQL}, x AS (SELECT category, passed, CASE WHEN category <> 'timeout' THEN total END AS total FROM samples) SELECT category, count(*) AS n, sum(passed)::BIGINT AS passed FROM x WHERE total > 0 AND passed = total GROUP BY category",
    "compare_roles": f"WITH {_ROLES_SQL} SELECT * FROM c",
    "comparison_summary": f"WITH {_ROLES_SQL} SELECT count(*) AS problems, count(*) FILTER (gained) AS gained, count(*) FILTER (regressed) AS regressed, count(*) FILTER (unreachable) AS unreachable, count(*) FILTER (reachable_miss) AS reachable_miss FROM c",
    "comparison_ids": f"WITH {_ROLES_SQL}, l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS list, idx FROM c WHERE {n}" for n in ("gained", "regressed", "unreachable", "reachable_miss")) + ") SELECT * FROM l ORDER BY list, idx",
    "truncation_by_role": "WITH p AS (SELECT CASE l_linenumber WHEN 1 THEN 'original' WHEN 2 THEN 'distilled' ELSE 'teacher' END AS role, l_orderkey, count(*) FILTER (l_quantity >= 45) AS t FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) SELECT role, sum(t)::BIGINT AS samples, count(*) FILTER (t > 0) AS problems FROM p GROUP BY role",
    "outcome_matrix": "WITH w AS (SELECT l_orderkey AS idx, " + ", ".join(f"coalesce(max(CASE WHEN l_linenumber = {i} THEN (l_linestatus = 'O')::INT END), 0) AS m{i}" for i in range(1, 8)) + " FROM lineitem GROUP BY l_orderkey) SELECT *, " + ", ".join(f"m{i} - m1 AS m{i}_delta" for i in range(2, 8)) + " FROM w",
    "verified_subset": "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang",
}
QUERIES = {name: globals()[name] for name in ORACLES}
