"""Record scans, sinks and streams as round trips: files made of whole tables are written to a shared folder by tasks and read back."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import curate, evaluate, sketches, stats
from tracewell.operators.ordering import materialized
from tracewell.plans.tables import PROBLEMS_SQL, SAMPLES_SQL, problems, samples, table
from tracewell.sources import file_ends, records, safetensors, scratch, sinks, stores
from tracewell.streaming import run_log


def _documents(spark, d):
    """Documents with what the record files are made of."""
    n = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), n.cast("string").alias("n"), F.floor(n / 100).cast("string").alias("part"))


def _files(rows, name, body, label: str) -> str:
    """A folder with a file for each row, written by the tasks that hold the rows."""
    folder = scratch.folder(rows.sparkSession, label)
    stores.put_files(rows.select(name.alias("name"), body.alias("body")), folder)
    return folder


def _traces(spark, d) -> str:
    """A trace of each document, whose tests all pass in every fourth; every fifth file is cut off."""
    tokens = F.array(F.lit("so "), F.lit("```python\n"), F.col("text"), F.lit("\n```"), F.lit(" done"))
    fields = {
        "prompt": F.concat(F.lit("Say "), F.col("lang"), F.lit(' "'), "n", F.lit('"')), "max_tokens": (F.col("doc_id") % 3 * 1000).cast("int"), "text": F.array_join(tokens, ""), "tokens": F.when(F.col("doc_id") % 7 > 0, tokens).otherwise(F.array().cast("array<string>")),
        "logprobs": F.array_repeat(F.create_map(F.lit("a"), F.lit(0.5)), 5), "top_k_ids": F.array_repeat(F.array(F.lit(1)), 5), "test_passed": (F.col("doc_id") % 4).cast("int"), "test_total": F.lit(3),
    }
    body = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    body = F.when(F.col("doc_id") % 5 == 0, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    return _files(_documents(spark, d), F.concat("part", F.lit("/"), "n", F.lit(".json")), body, "traces")


def keyed_traces(spark, d):
    """Readable, fully passed traces, cleaned."""
    return records.traces(spark, _traces(spark, d)).select("idx", "text", F.size("tokens").alias("n_tokens"))


def trace_lookup(spark, d):
    return records.lookup(spark, _traces(spark, d), 7).select("idx", "text", "test_passed")


def file_completeness(spark, d):
    return records.complete(spark, _traces(spark, d))


def tail_counts(spark, d):
    return records.tail_counts(spark, _traces(spark, d))


def cache_probe(spark, d):
    """Which cached traces may be kept, from the two ends of their files: documents of even languages changed their prompt since."""
    prompt = F.concat(F.lit("Say "), F.col("lang"), F.lit(' "'), "n", F.when(F.col("doc_id") % 6 == 0, '!').otherwise('"'))
    return records.cache_probe(spark, _traces(spark, d), _documents(spark, d).select(F.col("doc_id").alias("idx"), prompt.alias("prompt")), 2000)


def short_traces(spark, d):
    texts = F.transform(F.slice(F.array(*[F.lit(i) for i in range(4)]), F.lit(1), (F.col("doc_id") % 5).cast("int")), lambda i: F.concat(F.col("text"), i.cast("string")))
    body = F.to_json(F.struct(F.col("lang").alias("prompt"), F.lit(4).alias("attempts"), texts.alias("texts")))
    return records.short_traces(spark, _files(_documents(spark, d), F.concat("part", F.lit("/"), "n", F.lit(".json")), body, "short"))


def eval_records(spark, d):
    """A compact evaluation record for each hundred documents."""
    rows = _documents(spark, d).groupBy("part").agg(F.collect_list(F.struct(F.col("doc_id").alias("idx"), (F.col("doc_id") % 2 == 0).alias("solved"))).alias("rows"))
    body = F.to_json(F.struct(F.concat(F.lit("m"), "part").alias("name"), F.col("rows").alias("per_problem")))
    return records.eval_records(spark, _files(rows, F.concat(F.lit("m"), "part", F.lit(".json")), body, "eval"))


def settings_scan(spark, d):
    """A settings file for each document, with values of every kind, comments and a value at the top level."""
    body = F.concat(
        F.lit("# made for "), "n", F.lit("\nname: run "), "n", F.lit("\n\ndata:\n  lang: '"), "lang", F.lit("'\n  max_samples: "), F.length("text").cast("string"), F.lit("   # characters\n  seed:\nteacher:\n  top_p: 0."), (F.col("doc_id") % 9 + 1).cast("string"),
        F.lit("\n  chunked: "), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("False"), F.lit("\n  path: cache/a#"), "n", F.lit("\n"),
    )
    return records.settings(spark, _files(_documents(spark, d), F.concat("part", F.lit("/"), "n", F.lit(".yaml")), body, "settings"))


def model_summaries(spark, d):
    """A summary of each model (category) with totals by difficulty, written as JSON and read back."""
    rows = samples(spark, d).join(problems(spark, d), "idx").groupBy("category", "difficulty").agg(F.count("*").alias("n"), F.count_if("solved").alias("solved"))
    totals = rows.groupBy(F.col("category").alias("model")).agg(F.sum("n").alias("total"), F.sum("solved").alias("solved"), F.collect_list(F.struct("difficulty", "n", "solved")).alias("by_difficulty"))
    path = scratch.folder(spark, "summaries")
    sinks.summary(totals, path)
    back = spark.read.schema("model string, total long, solved long, by_difficulty array<struct<difficulty: string, n: long, solved: long>>").json(path)
    return back.select("model", "total", F.col("solved").alias("total_solved"), F.explode("by_difficulty").alias("x")).select("model", "total", "total_solved", "x.*")


def stored_sketches(spark, d):
    """Extra: sketches of each day and kind of event are stored, and merged to kinds; their counts and medians are within the stated errors of the exact ones."""
    rows = table(spark, d, "events").select("event_type", "event_id", "value", F.to_date("ts").alias("day"))
    path = scratch.folder(spark, "sketches")
    sketches.sketched(rows, ["day", "event_type"], "event_id", "value").write.partitionBy("day").parquet(path)
    found = sketches.estimates(sketches.merged(spark.read.parquet(path), ["event_type"]), ["event_type"], {"p50": 0.5}).withColumnRenamed("n", "n_merged")
    exact = rows.join(found, "event_type").groupBy("event_type", "n_merged", "n_distinct", "p50").agg(F.count_distinct("event_id").alias("ids"), (F.count_if(F.col("value") < F.col("p50")) / F.count("value")).alias("below"), (F.count_if(F.col("value") <= F.col("p50")) / F.count("value")).alias("upto"))
    near = F.abs(F.col("n_distinct") - F.col("ids")) <= 0.07 * F.col("ids")
    return exact.select("event_type", F.col("n_merged").alias("n"), "ids", near.alias("count_near"), ((F.col("below") <= 0.55) & (F.col("upto") >= 0.45)).alias("median_near"))


def plus_results(spark, d):
    """Whether the first sample of each task passed; every fifth task has none."""
    status = lambda c: F.struct(c.alias("plus_status"))
    samples = F.array(status(F.when(F.col("doc_id") % 3 > 0, "pass").otherwise("fail")), status(F.lit("pass")))
    rows = _documents(spark, d).withColumn("samples", F.when(F.col("doc_id") % 5 > 0, samples).otherwise(F.slice(samples, 1, 0)))
    rows = rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("t/"), "n"), "samples"))).alias("eval"))
    folder = _files(rows, F.concat("part", F.lit(".json")), F.to_json(F.struct("eval")), "plus")
    return records.plus_results(spark, folder).select("task", F.coalesce(F.col("solved").cast("string"), F.lit("no samples")).alias("solved"))


def id_lists(spark, d):
    """Document ids, a hundred to a file, in each of the forms that an id list may have."""
    rows = _documents(spark, d).groupBy("part").agg(F.collect_list("doc_id").alias("ids"))
    one = lambda i: F.when(i % 2 == 1, F.named_struct(F.lit("idx"), i, F.lit("id"), F.lit(None).cast("long"))).otherwise(F.named_struct(F.lit("idx"), F.lit(None).cast("long"), F.lit("id"), i))
    objects = F.transform("ids", one)
    forms = {"list": F.to_json("ids"), "ids": F.to_json(F.struct("ids")), "objects": F.to_json(objects), "broken": F.to_json(F.struct(objects.alias("broken")))}
    parts = [records.id_list(spark, _files(rows, F.concat("part", F.lit(".json")), body, form)).select(F.lit(form).alias("form"), "idx") for form, body in forms.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def report_scrape(spark, d):
    """A report for each hundred documents."""
    line = F.concat(F.lit("## Problem "), "n", F.lit(" ("), "lang", F.lit("): "), (F.col("doc_id") % 6).cast("string"), F.lit("/5 samples passed\ntext\n"))
    rows = _documents(spark, d).groupBy("part").agg(F.array_join(F.collect_list(line), "").alias("lines"))
    return records.report_lines(spark, _files(rows, F.concat("part", F.lit(".md")), F.concat(F.lit("# Report\n"), "lines"), "report"))


def folder_sizes(spark, d):
    """The bytes of all texts, in files of three kinds and many folders."""
    suffix = F.element_at(F.array(*map(F.lit, ("bin", "pt", "txt"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return records.folder_size(spark, _files(_documents(spark, d), F.concat("part", F.lit("/"), "n", F.lit("."), suffix), F.col("text"), "sizes"), [".bin", ".pt"])


def _tensors(spark, d):
    """All embeddings as safetensors, a matrix for each label in every shard."""
    folder = scratch.folder(spark, "tensors")
    rows = table(spark, d, "embeddings").where("size(embedding) = 64").select(F.concat(F.lit("label"), F.coalesce(F.col("label").cast("string"), F.lit("-"))).alias("name"), F.col("embedding").alias("values"))
    safetensors.write_shards(rows, folder)
    file_ends.register(spark, safetensors.Safetensors)
    rows = spark.read.format("safetensors").option("rowsPerPartition", "500").load(folder)
    return rows.select("name", "dtype", F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("sum"), F.element_at("values", 64).alias("last"))


def tensor_scan(spark, d):
    """Count, sum and greatest last component of the vectors of each tensor."""
    return _tensors(spark, d).groupBy("name", "dtype").agg(F.count("*").alias("n"), F.round(F.sum("sum"), 4).alias("total"), F.max("last").alias("last"))


def tensor_filter(spark, d):
    """The vectors of two tensors: the filter is applied when the scan is planned."""
    return _tensors(spark, d).where("name in ('label1', 'label3')").groupBy("name").agg(F.count("*").alias("n"), F.max("last").alias("last"))


def fresh_start(spark, d):
    """Results are removed once; there is nothing left to remove then."""
    path = sinks.replace_table(table(spark, d, "region"), scratch.folder(spark, "results"), 1)
    return spark.createDataFrame([(k, sinks.truncate(spark, path)) for k in (1, 2)], "attempt int, removed boolean")


def failed_rows_deleted(spark, d):
    """A new version of a table without the rows that did not pass all tests."""
    rows = samples(spark, d).select("idx", "category", F.col("passed").alias("test_passed"), F.when(F.col("category") != "timeout", F.col("total")).alias("test_total"))
    kept = spark.read.parquet(sinks.drop_failed(rows, scratch.folder(spark, "kept"), 1))
    return kept.groupBy("category").agg(F.count("*").alias("n"), F.sum("test_passed").alias("passed"))


def grid_checkpoint(spark, d):
    """Orders x samples in three parts: an earlier run left part 1 under the same settings and part 2 under others, so 0 and 2 are made now; the partial table is gone afterwards."""
    folder, part = scratch.folder(spark, "grid"), F.col("o_orderkey") % 3
    grid = table(spark, d, "orders").select("o_orderkey").crossJoin(spark.range(2).withColumnRenamed("id", "sample"))
    work = lambda run: lambda cells: cells.select("o_orderkey", "sample", (F.col("o_orderkey") * 10 + F.col("sample")).alias("value"), F.lit(run).alias("run"))
    settings = {"temperature": 0.2, "samples": 2}
    for number, made in ((1, {"samples": 2, "temperature": 0.2}), (2, {"samples": 2, "temperature": 0.8})):
        sinks.grid_part(work("earlier"), grid.where(part == number), f"{folder}/partial", number, sinks.settings_key(made))
    rows = sinks.grid_results(grid, part, work("now"), f"{folder}/partial", f"{folder}/whole", 3, settings)
    return rows.select("o_orderkey", "sample", "value", "run", F.lit(sinks.exists(spark, f"{folder}/partial")).alias("partial_left"))


def settings_cache(spark, d):
    """Totals of samples under settings that are asked for in turn: it is made anew under others, and is there when they come again."""
    folder, asked = scratch.folder(spark, "settings"), []
    for k, least in enumerate((10, 10, 30, 30, 10)):
        key = sinks.settings_key({"least": least, "by": "category"})
        rows, made = sinks.kept(spark, folder, key, lambda least=least: samples(spark, d).where(F.col("total") >= least).groupBy("category").agg(F.count("*").alias("n")))
        asked.append(rows.select(F.lit(k).alias("asked"), F.lit(made).alias("made"), "category", "n"))
    return functools.reduce(DataFrame.unionByName, asked)


def stale_snapshot(spark, d):
    """A snapshot of orders by status that is asked for five times: new, unchanged, after a source got a file, unchanged, and for other ids."""
    folder, rows = scratch.folder(spark, "sources"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    sources = [f"{folder}/source={k}" for k in range(2)]
    for k, path in enumerate(sources):
        rows.where(F.col("o_orderkey") % 2 == k).write.parquet(path)
    ids, asked = rows.select("o_orderkey"), []
    for k in range(5):
        if k == 2:
            rows.where("o_orderpriority = '1-URGENT'").write.mode("append").parquet(sources[1])
        if k == 4:
            ids = ids.where("o_orderkey % 5 <> 0")
        build = lambda ids=ids: spark.read.parquet(*sources).join(ids, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
        found, made = sinks.fresh_snapshot(spark, f"{folder}/snapshot", sources, build, ids)
        asked.append(found.select(F.lit(k).alias("asked"), F.lit(made).alias("made"), "o_orderstatus", "n"))
    return functools.reduce(DataFrame.unionByName, asked)


def stream_counters(spark, d):
    """Passes and failures by difficulty over all chunks of a streamed log, of which every other one is of the older generation."""
    old, folder = F.col("event_id") % 2 == 1, scratch.folder(spark, "counters")
    part = F.struct(F.lit(1).alias("pass"), (F.col("event_id") % 5).cast("int").alias("fail"))
    rows = table(spark, d, "events").where("event_type is not null").select(
        F.col("event_id").cast("double").alias("t"), F.lit("chunk").alias("kind"), F.when(old, 2).alias("chunk_pass"), F.when(old, 3).alias("chunk_fail"),
        F.when(~old, F.create_map("event_type", part)).alias("by_difficulty"),
    )
    rows.write.json(f"{folder}/in")
    for batches in (1, None):  # by files one by one, then by what is left
        query = run_log.durable_counters(run_log.read_events(spark, f"{folder}/in", batches), f"{folder}/counts", f"{folder}/checkpoint")
        query.awaitTermination()
    return run_log.newest(spark, f"{folder}/counts")


def retry_once(spark, d):
    """Orders through two attempts, which fail for different ones."""
    attempt = lambda rows, k: rows.withColumn("ok", F.col("o_orderkey") % (3 + 2 * k) != 0)
    return evaluate.retry_once(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), attempt, materialized)


def staged_recovery(spark, d):
    """Problems whose first sample failed: tested again, then sampled twice more, up to the first pass; the run is stopped after the first stage and started anew."""
    rows, folder = samples(spark, d), scratch.folder(spark, "recovery")
    failed = rows.where("j = 0 and not solved").select("idx")
    of = lambda first: lambda problems, attempt: rows.where(F.col("j") == first + attempt).join(problems, "idx", "left_semi").select("idx", "solved")
    stages = [("retest", 1, of(0)), ("resample", 2, of(1))]
    evaluate.recover(failed, stages[:1], folder)
    return evaluate.recover(failed, stages, folder)


def recovery_totals(spark, d):
    """Recovered and still failing by chunk of problems and difficulty, with totals so far."""
    first = samples(spark, d).where("j = 0").join(problems(spark, d), "idx").withColumn("difficulty", evaluate.normal_difficulty(F.col("difficulty"))).withColumn("chunk", F.floor(F.col("idx") / 500))
    later = samples(spark, d).where("j > 0").groupBy("idx").agg(F.bool_or("solved").alias("solved"))
    return evaluate.recovery_totals(first, later, "difficulty", "chunk")


def invalid_cache(spark, d):
    """Cached rows that must be made anew."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    p = lambda c: F.concat(F.lit("p"), (c % 2).cast("string"))
    ok = curate.cache_valid(p(F.col("n_chars")), p(F.col("doc_id")), F.col("n_chars") - 400, F.col("quality") == 1, F.col("n_chars"), 2000, False)
    return curate.invalid(rows, ok).select("doc_id")


def projection_means(spark, d):
    """Count and means by projection type; types without rows are left out."""
    kind = F.when(F.col("l_returnflag") == "R", "q_proj").when(F.col("l_returnflag") == "A", "down_proj")
    rows = table(spark, d, "lineitem").select(kind.alias("proj"), "l_discount", "l_tax", "l_quantity")
    return stats.means_by(rows, "proj", ["q_proj", "k_proj", "down_proj"], ["l_discount", "l_tax", "l_quantity"], 6)


def retention_table(spark, d):
    """What is left of a score after a reduction, by model."""
    scores = samples(spark, d).groupBy("category").agg(F.sum("total").cast("double").alias("base"), F.sum("passed").cast("double").alias("reduced"))
    rows = scores.unionAll(spark.createDataFrame([("none", 0.0, 0.0)], scores.schema))
    return evaluate.retention(rows, F.col("base"), F.col("reduced")).select("category", "gap", F.round("ratio", 6).alias("ratio"), F.round("retention", 4).alias("retention"))


_DOC = "(SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents)"
_CLEAN = "'```python' || chr(10) || text || chr(10) || '```'"
_KEPT = f"CASE WHEN doc_id % 7 > 0 THEN {_CLEAN} ELSE 'so ```python' || chr(10) || text || chr(10) || '``` done' END"
ORACLES = {
    "keyed_traces": f"SELECT doc_id AS idx, {_KEPT} AS text, CASE WHEN doc_id % 7 > 0 THEN 3 ELSE 0 END AS n_tokens FROM {_DOC} WHERE doc_id % 4 = 3 AND doc_id % 5 <> 0",
    "trace_lookup": f"SELECT doc_id AS idx, {_KEPT} AS text, (doc_id % 4)::INT AS test_passed FROM {_DOC} WHERE doc_id = 7",
    "file_completeness": "SELECT doc_id::VARCHAR AS stem, doc_id % 5 <> 0 AS complete FROM documents",
    "tail_counts": "SELECT doc_id AS idx, (doc_id % 4)::INT AS test_passed, CASE WHEN doc_id % 5 <> 0 THEN 3 END AS test_total FROM documents",
    "cache_probe": "SELECT doc_id AS idx, doc_id % 6 <> 0 AND doc_id % 7 > 0 AND (doc_id % 4 = 3 AND doc_id % 5 <> 0 OR doc_id % 3 = 2) AS valid FROM documents",
    "short_traces": f"SELECT idx, prompt, sample::INT AS sample, text || sample AS text FROM (SELECT doc_id AS idx, lang AS prompt, text, unnest(range(doc_id % 5)) AS sample FROM {_DOC})",
    "eval_records": "SELECT 'm' || doc_id // 100 AS record, doc_id AS idx, doc_id % 2 = 0 AS solved FROM documents",
    "settings_scan": f"""SELECT doc_id::VARCHAR AS file, v.section, v.key, v.value, v.kind FROM (SELECT doc_id, unnest([
{{'section': '', 'key': 'name', 'value': 'run ' || doc_id, 'kind': 'str'}}, {{'section': 'data', 'key': 'lang', 'value': lang, 'kind': 'str'}}, {{'section': 'data', 'key': 'max_samples', 'value': length(text)::VARCHAR, 'kind': 'int'}}, {{'section': 'data', 'key': 'seed', 'value': NULL, 'kind': 'null'}},
{{'section': 'teacher', 'key': 'top_p', 'value': '0.' || (doc_id % 9 + 1), 'kind': 'float'}}, {{'section': 'teacher', 'key': 'chunked', 'value': (doc_id % 2 = 0)::VARCHAR, 'kind': 'bool'}}, {{'section': 'teacher', 'key': 'path', 'value': 'cache/a#' || doc_id, 'kind': 'str'}}]) AS v FROM {_DOC})""",
    "model_summaries": f"""WITH {SAMPLES_SQL}, {PROBLEMS_SQL}, r AS (SELECT category AS model, difficulty, count(*) AS n, count(*) FILTER (solved) AS solved FROM samples JOIN problems USING (idx) GROUP BY 1, 2)
SELECT model, (sum(n) OVER w)::BIGINT AS total, (sum(solved) OVER w)::BIGINT AS total_solved, difficulty, n, solved FROM r WINDOW w AS (PARTITION BY model)""",
    "stored_sketches": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, true AS count_near, true AS median_near FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    "plus_results": "SELECT 't/' || doc_id AS task, CASE WHEN doc_id % 5 = 0 THEN 'no samples' WHEN doc_id % 3 <> 0 THEN 'true' ELSE 'false' END AS solved FROM documents",
    "id_lists": "SELECT form, doc_id AS idx FROM documents, (VALUES ('list'), ('ids'), ('objects'), ('broken')) f(form)",
    "report_scrape": "SELECT doc_id AS idx, (doc_id % 6)::INT AS passed FROM documents",
    "folder_sizes": "SELECT CASE doc_id % 3 WHEN 0 THEN '.bin' ELSE '.pt' END AS suffix, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents WHERE doc_id % 3 < 2 GROUP BY 1",
    "tensor_scan": "SELECT 'label' || coalesce(label::VARCHAR, '-') AS name, 'F32' AS dtype, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total, max(embedding[64])::DOUBLE AS last FROM embeddings WHERE len(embedding) = 64 GROUP BY 1",
    "tensor_filter": "SELECT 'label' || label AS name, count(*) AS n, max(embedding[64])::DOUBLE AS last FROM embeddings WHERE len(embedding) = 64 AND label IN (1, 3) GROUP BY 1",
    "fresh_start": "SELECT * FROM (VALUES (1, true), (2, false)) v(attempt, removed)",
    "failed_rows_deleted": f"WITH {SAMPLES_SQL} SELECT category, count(*) AS n, sum(passed)::BIGINT AS passed FROM samples WHERE category <> 'timeout' AND total > 0 AND passed = total GROUP BY category",
    "grid_checkpoint": "SELECT o_orderkey, sample, o_orderkey * 10 + sample AS value, CASE o_orderkey % 3 WHEN 1 THEN 'earlier' ELSE 'now' END AS run, false AS partial_left FROM orders, range(2) r(sample)",
    "settings_cache": f"WITH {SAMPLES_SQL} SELECT asked, made, category, count(*) AS n FROM samples, (VALUES (0, true, 10), (1, false, 10), (2, true, 30), (3, false, 30), (4, false, 10)) v(asked, made, least) WHERE total >= least GROUP BY 1, 2, 3",
    "stale_snapshot": "SELECT asked, made, o_orderstatus, (count(*) + CASE WHEN asked >= 2 THEN count(*) FILTER (o_orderpriority = '1-URGENT') ELSE 0 END)::BIGINT AS n FROM orders, (VALUES (0, true), (1, false), (2, true), (3, false), (4, true)) v(asked, made) WHERE asked < 4 OR o_orderkey % 5 <> 0 GROUP BY 1, 2, 3",
    "stream_counters": "SELECT CASE WHEN event_id % 2 = 1 THEN '?' ELSE event_type END AS difficulty, sum(CASE WHEN event_id % 2 = 1 THEN 2 ELSE 1 END)::BIGINT AS passed, sum(CASE WHEN event_id % 2 = 1 THEN 3 ELSE event_id % 5 END)::BIGINT AS failed FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "retry_once": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 2 END AS attempts, o_orderkey % 15 = 0 AS dead FROM orders",
    "staged_recovery": f"""WITH {SAMPLES_SQL}, s AS (SELECT idx, bool_or(solved) FILTER (j = 1) AS a, bool_or(solved) FILTER (j = 2) AS b, bool_or(solved) FILTER (j = 3) AS c FROM samples GROUP BY idx HAVING NOT bool_or(solved) FILTER (j = 0))
SELECT idx, CASE WHEN a THEN 'retest' ELSE 'resample' END AS stage, (CASE WHEN a OR b THEN 1 ELSE 2 END)::INT AS attempt, coalesce(a OR b OR c, false) AS solved FROM s""",
    "recovery_totals": f"""WITH {SAMPLES_SQL}, {PROBLEMS_SQL}, l AS (SELECT idx, bool_or(solved) AS now FROM samples WHERE j > 0 GROUP BY idx),
f AS (SELECT idx // 500 AS chunk, CASE WHEN trim(difficulty) = '' THEN 'unknown' ELSE lower(trim(difficulty)) END AS difficulty, coalesce(now, false) AS now FROM samples s JOIN problems USING (idx) LEFT JOIN l USING (idx) WHERE j = 0 AND NOT solved),
c AS (SELECT chunk, difficulty, count(*) FILTER (now) AS recovered, count(*) FILTER (NOT now) AS failing FROM f GROUP BY 1, 2)
SELECT *, (sum(recovered) OVER w)::BIGINT AS total_recovered, (sum(failing) OVER w)::BIGINT AS total_failing FROM c WINDOW w AS (PARTITION BY difficulty ORDER BY chunk ROWS UNBOUNDED PRECEDING)""",
    "invalid_cache": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE NOT coalesce((n_chars % 2 = doc_id % 2) AND n_chars > 400 AND (coalesce(quality = 1, false) OR n_chars >= 2000), false)",
    "projection_means": "SELECT CASE l_returnflag WHEN 'R' THEN 'q_proj' ELSE 'down_proj' END AS proj, count(*) AS n, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax, round(avg(l_quantity), 6) AS l_quantity FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1",
    "retention_table": f"WITH {SAMPLES_SQL}, s AS (SELECT category, sum(total)::DOUBLE AS base, sum(passed)::DOUBLE AS reduced FROM samples GROUP BY 1 UNION ALL SELECT 'none', 0, 0) SELECT category, reduced - base AS gap, round(reduced / nullif(base, 0), 6) AS ratio, round(100 * (reduced / nullif(base, 0)), 4) AS retention FROM s",
}
QUERIES = {name: globals()[name] for name in ORACLES}
