"""Round trips through the file sources and sinks, and reports built as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import evaluate
from tracewell.plans.tables import SAMPLES_SQL, samples, table
from tracewell.sources import records, scratch, sinks


def run_log_scan(spark, d):
    """Events written as JSON lines and scanned with the nullable union schema."""
    rows = table(spark, d, "events").select(
        F.col("event_id").cast("double").alias("t"), F.when(F.col("event_type") == "view", "build_start").otherwise("chunk").alias("kind"), F.when(F.col("event_type") != "view", F.col("event_id").cast("int")).alias("idx"),
        F.when(F.col("event_type") == "click", F.create_map(F.lit("timeout"), F.lit(2), F.col("event_type"), F.lit(1))).alias("fail_causes"),
    )
    path = scratch.folder(spark, "run-log")
    sinks.json_lines(rows, path)
    return records.run_log(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.sum("idx").alias("idx"), F.sum(F.coalesce(F.aggregate(F.map_values("fail_causes"), F.lit(0), lambda a, x: a + x), F.lit(0))).cast("bigint").alias("causes"))


def versioned_upsert(spark, d):
    """Monotone upsert written as a new version of a table, then reread."""
    labels, path = table(spark, d, "labels"), scratch.folder(spark, "upsert")
    first = sinks.replace_table(labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("idx"), (F.col("quality") == 1).alias("passed"), F.lit(1).alias("version")), path, 1)
    new = labels.where("doc_id % 3 = 0").select(F.col("doc_id").alias("idx"), (F.col("toxic") == 1).alias("passed"), F.lit(2).alias("version"))
    return spark.read.parquet(sinks.upsert(spark.read.parquet(first), new, path, 2))


def fingerprinted_snapshot(spark, d):
    """A materialized aggregate under a fingerprint; the second request reads what the first wrote."""
    path, rows = scratch.folder(spark, "snapshot"), table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    sinks.snapshot(rows, path, "v1")
    return sinks.snapshot(rows.where("false"), path, "v1")


def event_status(spark, d):
    """Two batches appended to a log, and the latest status of each run after the second."""
    log, status = scratch.folder(spark, "log"), scratch.folder(spark, "status")
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").cast("double").alias("t"), "event_type")
    half = rows.agg(F.expr("max(t) / 2")).first()[0]
    for number, part in enumerate((rows.where(F.col("t") <= half), rows.where(F.col("t") > half))):
        sinks.append_events(part, log, status, number)
    return spark.read.parquet(f"{status}/v=1").select("run", "t", "event_type")


def failure_report(spark, d):
    """Markdown sections of problems with their first distinct failures."""
    rows = samples(spark, d).where("not solved")
    fails = rows.select("idx", (F.col("j") + 1).alias("nth"), "category", F.concat(F.lit(" at   line "), F.col("total").cast("string")).alias("error"))
    heads = evaluate.first_success(samples(spark, d)).select("idx", F.concat(F.lit("def f"), F.col("j").cast("string"), F.lit("(): pass")).alias("code"))
    return sinks.failure_report(heads, fails)


def fixed_width_table(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return sinks.fixed_width(rows, {"n_name": -20, "n_nationkey": 6, "n_regionkey": 4})


def solution_lines(spark, d):
    """{task_id, solution} lines written and reread."""
    path = scratch.folder(spark, "solutions")
    sinks.solutions(table(spark, d, "benchmark").select(F.concat(F.lit("task/"), F.col("item_id").cast("string")).alias("task_id"), F.col("text").alias("solution")), path)
    return spark.read.schema("task_id string, solution string").json(path)


ORACLES = {
    "run_log_scan": "SELECT CASE WHEN event_type = 'view' THEN 'build_start' ELSE 'chunk' END AS kind, count(*) AS n, sum(event_id) FILTER (event_type <> 'view')::BIGINT AS idx, (3 * count(*) FILTER (event_type = 'click'))::BIGINT AS causes FROM events GROUP BY 1",
    "versioned_upsert": "WITH u AS (SELECT doc_id AS idx, quality = 1 AS passed, 1 AS version FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, toxic = 1, 2 FROM labels WHERE doc_id % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY passed DESC, version DESC) AS k FROM u) SELECT idx, passed, version FROM r WHERE k = 1",
    "fingerprinted_snapshot": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "event_status": "WITH r AS (SELECT user_id AS run, event_id::DOUBLE AS t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT run, t, event_type FROM r WHERE k = 1",
    "failure_report": f"WITH {SAMPLES_SQL}, h AS (SELECT idx, substr('def f' || min(j) || '(): pass', 1, 4000) AS code FROM samples WHERE solved GROUP BY idx), l AS (SELECT idx, string_agg('- ' || category || ': at line ' || total, chr(10) ORDER BY j) AS l FROM samples WHERE NOT solved AND j <= 2 GROUP BY idx) SELECT idx, concat_ws(chr(10), '## Problem ' || idx, '```python', code, '```', l) AS section FROM h LEFT JOIN l USING (idx)",
    "fixed_width_table": "SELECT rpad(n_name, 20, ' ') || ' ' || lpad(n_nationkey::VARCHAR, 6, ' ') || ' ' || lpad(n_regionkey::VARCHAR, 4, ' ') AS line FROM nation",
    "solution_lines": "SELECT 'task/' || item_id AS task_id, text AS solution FROM benchmark",
}
QUERIES = {name: globals()[name] for name in ORACLES}
