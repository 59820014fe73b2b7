"""Telemetry queries: events as a run log, users as runs, and round trips through the file sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import telemetry, temporal
from tracewell.plans.tables import samples, table


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")


def running_pass_rate(spark, d):
    rows = telemetry.running_rate(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "click")
    rows = telemetry.with_eta(rows, F.col("done") * F.lit(2.5), F.lit(100))
    return rows.select("event_id", "done", "total_pass", F.round("pass_rate", 6).alias("pass_rate"), F.round("eta", 6).alias("eta"))


def running_best(spark, d):
    """Validation every third event: least value so far, and whether it improved."""
    rows = _events(spark, d).where("event_id % 3 = 0")
    return telemetry.running_best(rows, "user_id", ["ts", "event_id"], "value").select("event_id", "value", "best", "improved")


def status_snapshot(spark, d):
    return telemetry.latest(_events(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def epoch_running_means(spark, d):
    rows = _events(spark, d).withColumn("epoch", F.col("event_id") % 7)
    return telemetry.epoch_means(rows, "epoch", ["value"]).select("epoch", F.round("value", 6).alias("value"), "batches")


def throughput(spark, d):
    rows = samples(spark, d)
    return telemetry.throughput(rows, "category", "passed", "total").select("category", F.round("per_second", 6).alias("per_second"))


def resume_pending(spark, d):
    """Work left after an interrupted run: rows of settings that differ, or of keys without a result."""
    wanted = table(spark, d, "orders").select("o_orderkey", text.fingerprint(F.col("o_orderstatus"), F.lit(5)).alias("settings"))
    done = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("s")).select(F.col("l_orderkey").alias("o_orderkey"), text.fingerprint(F.col("s"), F.lit(5)).alias("settings"))
    left = wanted.join(done, ["o_orderkey", "settings"], "left_anti")
    return left.groupBy("settings").agg(F.count("*").alias("pending"))


def chunk_eta(spark, d):
    """Totals by chunk with a formatted estimate of the time left."""
    rows = _events(spark, d).groupBy(F.floor(F.col("event_id") / 500).alias("chunk")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("passed"))
    return rows.select("chunk", "n", "passed", text.clock(F.col("n") * 13 + F.col("chunk")).alias("eta"), F.expr("passed * 100 div n").alias("percent"))


def last_view(spark, d):
    """Extra: each purchase with the last view of the same user before it."""
    rows = _events(spark, d)
    views = rows.where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("event_id").alias("view"))
    return temporal.as_of(rows.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, ["user_id"], "ts", "event_id", ["view"]).select("event_id", "last_view")


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def event_sessions(spark, d):
    """Extra: sessions of users, parted by twelve hours without an event."""
    rows = temporal.sessions(_events(spark, d), ["user_id"], "ts", "12 hours")
    return rows.select("user_id", _micros("first").alias("first"), _micros("last").alias("last"), "n")


def errors_in_sessions(spark, d):
    """Extra: how many errors fall into each session, by a join of points with intervals."""
    rows = _events(spark, d)
    sessions = temporal.sessions(rows, ["user_id"], "ts", "12 hours").select("user_id", "first", "last")
    errors = rows.where("event_type = 'error'").select("user_id", "ts")
    found = temporal.in_intervals(errors, sessions, ["user_id"], _micros("ts"), _micros("first"), _micros("last") + 1, 6 * 3.6e9)
    return found.groupBy("user_id", _micros("first").alias("first")).agg(F.count("*").alias("errors"))


def status_cube(spark, d):
    """Extra: orders by status and priority, by each, and in all."""
    return temporal.levels(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], F.count("*").alias("n"), F.max("o_totalprice").alias("largest"))


_SESSIONS_SQL = """g AS (SELECT user_id, ts, event_type, coalesce(ts - lag(ts) OVER w > INTERVAL 12 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"""
ORACLES = {
    "last_view": "SELECT p.event_id, max((v.ts, v.event_id))[2] AS last_view FROM events p LEFT JOIN events v ON v.user_id IS NOT DISTINCT FROM p.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) <= (p.ts, p.event_id) WHERE p.event_type = 'purchase' GROUP BY 1",
    "event_sessions": f"WITH {_SESSIONS_SQL} SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM k GROUP BY user_id, k",
    "errors_in_sessions": f"WITH {_SESSIONS_SQL} SELECT user_id, epoch_us(min(ts)) AS first, count(*) FILTER (event_type = 'error') AS errors FROM k WHERE user_id IS NOT NULL GROUP BY user_id, k HAVING count(*) FILTER (event_type = 'error') > 0",
    "status_cube": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "running_pass_rate": "WITH r AS (SELECT event_id, row_number() OVER w AS done, sum((event_type = 'click')::INT) OVER w AS ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, done, ok::BIGINT AS total_pass, round(ok / done, 6) AS pass_rate, round(done * 2.5::DOUBLE / done * (100 - done), 6) AS eta FROM r",
    "running_best": "WITH r AS (SELECT event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events WHERE event_id % 3 = 0) SELECT event_id, value, least(coalesce(b, value), value) AS best, coalesce(value < b, true) AS improved FROM r",
    "status_snapshot": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE k = 1",
    "epoch_running_means": "SELECT event_id % 7 AS epoch, round(sum(value) / greatest(count(value), 1), 6) AS value, count(*) AS batches FROM events GROUP BY 1",
    "throughput": "WITH x AS (SELECT CASE l_returnflag WHEN 'R' THEN 'runtime_error' WHEN 'A' THEN 'wrong_answer' ELSE 'timeout' END AS category, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE floor(l_quantity * l_discount) END AS p, l_quantity AS t FROM lineitem) SELECT category, round(sum(p) / sum(t), 6) AS per_second FROM x GROUP BY category",
    "resume_pending": "WITH d AS (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem GROUP BY 1) SELECT o_orderstatus || ':5' AS settings, count(*) AS pending FROM orders WHERE NOT EXISTS (SELECT 1 FROM d WHERE k = o_orderkey AND s = o_orderstatus) GROUP BY 1",
    "chunk_eta": "WITH c AS (SELECT event_id // 500 AS chunk, count(*) AS n, count(*) FILTER (event_type = 'click') AS passed FROM events GROUP BY 1) SELECT chunk, n, passed, printf('%dh %02dm %02ds', (n * 13 + chunk) // 3600, (n * 13 + chunk) % 3600 // 60, (n * 13 + chunk) % 60) AS eta, passed * 100 // n AS percent FROM c",
}
QUERIES = {name: globals()[name] for name in ORACLES}
