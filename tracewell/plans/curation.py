"""Curation queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import batching, curate
from tracewell.operators.ordering import positions
from tracewell.plans.tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")


def pending_keys(spark, d):
    return curate.pending(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def cache_audit(spark, d):
    wanted = _docs(spark, d).select("doc_id", F.concat(F.lit("p"), (F.col("n_chars") % 3).cast("string")).alias("prompt"))
    cached = table(spark, d, "labels").select("doc_id", F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("prompt"), (F.col("quality") == 1).alias("passed"))
    return curate.cache_audit(wanted, cached, "doc_id")


def cache_validity(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    p = lambda c: F.concat(F.lit("p"), (c % 2).cast("string"))
    ok = curate.cache_valid(p(F.col("n_chars")), p(F.col("doc_id")), F.col("n_chars") - 400, F.col("quality") == 1, F.col("n_chars"), 2000, False)
    return rows.select("doc_id", ok.alias("valid"))


def monotone_upsert(spark, d):
    labels = table(spark, d, "labels")
    old = labels.where("doc_id % 3 <> 0").select("doc_id", (F.col("quality") == 1).alias("passed"), F.lit("old").alias("origin"))
    new = labels.where("doc_id % 2 = 0").select("doc_id", (F.col("toxic") == 1).alias("passed"), F.lit("new").alias("origin"))
    return curate.monotone_upsert(old, new, "doc_id", "passed")


def merge_last_writer(spark, d):
    labels = table(spark, d, "labels")
    tables = [labels.where(f"doc_id % {k} = 0").select("doc_id", F.lit(k).alias("wave")) for k in (2, 3, 5)]
    return curate.last_writer_wins(tables, "doc_id")


def length_filter(spark, d):
    rows = _docs(spark, d).where(curate.fits(F.length("lang") * 100, F.col("n_chars"), 2048))
    return rows.select("doc_id", "n_chars", *curate.truncated(F.length("lang") * 1000, F.col("n_chars"), 2500))


def curriculum_order(spark, d):
    return curate.curriculum(_docs(spark, d).select("doc_id", "n_chars"), "n_chars", "doc_id")


def pack_by_budget(spark, d):
    rows = _docs(spark, d).select("lang", "doc_id", "n_chars")
    return batching.pack_by_budget(rows, "lang", "doc_id", "n_chars", 8, 16384)


def chunking(spark, d):
    rows = curate.curriculum(_docs(spark, d).select("doc_id", "n_chars"), "n_chars", "doc_id")
    return rows.groupBy(curate.chunk(F.col("place"), 64).alias("chunk")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def train_val_split(spark, d):
    """Positional split of problems, then short records of validation problems are kept out of training."""
    docs = curate.split_at(positions(table(spark, d, "documents").select("doc_id"), ["doc_id"]), "place", 0.9)
    keys = table(spark, d, "conversations").select(curate.short_key(F.col("conv_id"), F.col("turn")).alias("key"))
    short = curate.leak_free(keys, docs.where("split = 'val'"), curate.problem_of(F.col("key")), "doc_id")
    return docs.select(F.col("doc_id").alias("key"), "split").unionByName(short.select("key", F.lit("short").alias("split")))


def hard_oversample(spark, d):
    rows = curate.oversample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderpriority") == "1-URGENT", 3)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("copy").cast("bigint").alias("extra"))


def data_mix(spark, d):
    """short_only / long_only / mix by the class of the key."""
    rows = table(spark, d, "conversations").select(F.when(F.col("role") == "assistant", curate.short_key(F.col("conv_id"), F.col("turn"))).otherwise(F.col("conv_id")).alias("key"))
    short = F.col("key") >= 1_000_000
    modes = rows.withColumn("mode", F.explode(F.when(short, F.array(F.lit("short_only"), F.lit("mix"))).otherwise(F.array(F.lit("long_only"), F.lit("mix")))))
    return modes.groupBy("mode").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


def interleave_waves(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    return curate.interleave(rows, "conv_id", "role", "turn", 3).select("conv_id", F.col("nth").cast("int").alias("nth"), "turn", "role")


def ordered_distinct(spark, d):
    """Distinct non-blank lines of each document in order of first appearance."""
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return _docs(spark, d).select("doc_id", F.size(lines).cast("bigint").alias("n"), F.md5(F.array_join(lines, "\n")).alias("digest"))


def seeded_sample(spark, d):
    return curate.seeded_sample(_docs(spark, d).select("doc_id", "lang"), "doc_id", 100, 42)


def set_operations(spark, d):
    """Intersection, union, difference and equality of two key sets."""
    a, b = table(spark, d, "labels").where("quality = 1").select("doc_id"), table(spark, d, "labels").where("toxic = 0").select("doc_id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    both_ways = a.exceptAll(b).unionAll(b.exceptAll(a))
    return count(a.intersect(b), "intersect").unionAll(count(a.union(b).distinct(), "union")).unionAll(count(a.subtract(b), "except")).unionAll(count(both_ways, "unequal"))


def cross_products(spark, d):
    """Prompts x samples, and their count by language."""
    rows = _docs(spark, d).select("doc_id", "lang").crossJoin(spark.range(4).withColumnRenamed("id", "sample"))
    return rows.groupBy("lang", "sample").agg(F.count("*").alias("n"))


def schema_check(spark, d):
    """Keys missing on either side of two tables, and pairs that are in both."""
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    side = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return side(a.join(b, "doc_id", "left_anti"), "only_a").unionAll(side(b.join(a, "doc_id", "left_anti"), "only_b")).unionAll(side(a.join(b, "doc_id"), "both"))


def label_masking(spark, d):
    """Prompt positions masked in the labels, and the response mask shifted left."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.sequence(F.lit(1).cast("bigint"), F.col("turn") + 1).alias("p"), F.transform(F.split("role", ""), lambda x: F.ascii(x).cast("bigint")).alias("r"))
    mask = F.concat(F.transform("p", lambda _: F.lit(False)), F.transform("r", lambda _: F.lit(True)))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("conv_id", "turn", text(curate.label_mask(F.col("p"), F.col("r"))).alias("labels"), F.array_join(F.transform(curate.shift_left(mask), lambda x: F.when(x, "1").otherwise("0")), "").alias("predict")).distinct()


def padded_batches(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.sequence(F.lit(1).cast("bigint"), F.col("turn") + 1).alias("ids")).distinct()
    out = curate.padded(rows, "conv_id", "ids", 0)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return out.select("conv_id", "turn", text(F.col("input_ids")).alias("input_ids"), text(F.col("mask")).alias("mask"), text(F.col("labels")).alias("labels"))


def early_stop_scan(spark, d):
    """The first rows by position that pass a filter: a positional cap, then difficulty and length filters."""
    rows = _docs(spark, d).where((F.col("doc_id") < 800) & F.lower("lang").isin("en", "de") & (F.col("n_chars") <= 2000))
    return rows.orderBy("doc_id").limit(50).select("doc_id", "lang", "n_chars")


def numeric_file_order(spark, d):
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return _docs(spark, d).select("doc_id", curate.numeric_name_order(name).alias("place"))


def difficulty_filter(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.initcap(F.substring("o_orderpriority", 3, 20)).alias("difficulty"))
    return rows.where(curate.difficulties(F.col("difficulty"), "urgent+ Low")).groupBy("difficulty").agg(F.count("*").alias("n"))


def seeded_shuffle(spark, d):
    """Where a seeded shuffle puts each document."""
    return curate.shuffled(_docs(spark, d).select("doc_id", "lang"), "doc_id", 7)


def calibration_texts(spark, d):
    return curate.calibration(_docs(spark, d).select("doc_id", "n_chars"), "doc_id", "n_chars", 900, 1500, 64)


def event_days(spark, d):
    """Dates and clock times of events as text, counted by day."""
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm:ss").alias("clock"))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.min("clock").alias("first"), F.max("clock").alias("last"))


_CUR = "(row_number() OVER (ORDER BY n_chars, doc_id) - 1)"
_PACK = """WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
f AS (SELECT lang, doc_id, n_chars, k, 0::BIGINT AS batch, 1::BIGINT AS cnt, n_chars AS longest FROM o WHERE k = 1
UNION ALL SELECT o.lang, o.doc_id, o.n_chars, o.k, CASE WHEN cnt + 1 > 8 OR greatest(longest, o.n_chars) * (cnt + 1) > 16384 THEN batch + 1 ELSE batch END,
CASE WHEN cnt + 1 > 8 OR greatest(longest, o.n_chars) * (cnt + 1) > 16384 THEN 1 ELSE cnt + 1 END, CASE WHEN cnt + 1 > 8 OR greatest(longest, o.n_chars) * (cnt + 1) > 16384 THEN o.n_chars ELSE greatest(longest, o.n_chars) END
FROM f JOIN o ON o.lang = f.lang AND o.k = f.k + 1) SELECT lang, doc_id, n_chars, batch FROM f"""
ORACLES = {
    "pending_keys": "SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "cache_audit": "WITH x AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.n_chars % 3 = l.doc_id % 3 THEN 'matched' ELSE 'mismatched' END AS state, coalesce(quality = 1, false) AS passing FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT state, passing, count(*) AS n FROM x GROUP BY 1, 2",
    "cache_validity": "SELECT doc_id, (n_chars % 2 = doc_id % 2) AND n_chars > 400 AND (quality = 1 OR n_chars >= 2000) AS valid FROM documents JOIN labels USING (doc_id)",
    "monotone_upsert": "WITH o AS (SELECT doc_id, quality = 1 AS passed, 'old' AS origin, 0 AS v FROM labels WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, toxic = 1 AS passed, 'new' AS origin, 1 AS v FROM labels WHERE doc_id % 2 = 0), u AS (SELECT * FROM o UNION ALL SELECT * FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY passed DESC, v DESC) AS k FROM u) SELECT doc_id, passed, origin FROM r WHERE k = 1",
    "merge_last_writer": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 5 WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS wave FROM labels WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0",
    "length_filter": "SELECT doc_id, n_chars, least(length(lang) * 1000, 2499)::INT AS prompt_kept, least(n_chars, 2500 - least(length(lang) * 1000, 2499)) AS response_kept FROM documents WHERE least(length(lang) * 100, 2047) + n_chars + 1 <= 2048",
    "curriculum_order": f"SELECT doc_id, n_chars, {_CUR} AS place FROM documents",
    "pack_by_budget": _PACK,
    "chunking": f"WITH o AS (SELECT n_chars, {_CUR} // 64 AS chunk FROM documents) SELECT chunk, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM o GROUP BY chunk",
    "train_val_split": "WITH o AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM documents) SELECT doc_id AS key, split FROM o UNION ALL SELECT 1000000 + conv_id * 100 + turn, 'short' FROM conversations WHERE conv_id + turn // 100 NOT IN (SELECT doc_id FROM o WHERE split = 'val')",
    "hard_oversample": "SELECT o_orderpriority, count(*) * max(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 1 END) AS n, count(*) * max(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 0 END) AS extra FROM orders GROUP BY 1",
    "data_mix": "WITH k AS (SELECT CASE WHEN role = 'assistant' THEN 1000000 + conv_id * 100 + turn ELSE conv_id END AS key FROM conversations), m AS (SELECT key, CASE WHEN key >= 1000000 THEN 'short_only' ELSE 'long_only' END AS mode FROM k UNION ALL SELECT key, 'mix' FROM k) SELECT mode, count(*) AS n, count(DISTINCT key) AS keys FROM m GROUP BY mode",
    "interleave_waves": "WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INTEGER) AS nth FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) SELECT conv_id, nth, turn, role FROM r WHERE nth <= 3",
    "ordered_distinct": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), f AS (SELECT doc_id, line, min(p) AS p FROM l WHERE trim(line) <> '' GROUP BY 1, 2) SELECT doc_id, count(line) AS n, md5(coalesce(string_agg(line, chr(10) ORDER BY p), '')) AS digest FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id",
    "seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100",
    "set_operations": "WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 0) SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'unequal', count(*) FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))",
    "cross_products": "SELECT lang, sample, count(*) AS n FROM documents, range(4) r(sample) GROUP BY 1, 2",
    "schema_check": "SELECT 'only_a' AS side, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'only_b', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'both', count(*) FROM documents JOIN labels USING (doc_id)",
    "label_masking": "SELECT DISTINCT conv_id, turn, repeat('-100,', (turn + 1)::BIGINT) || array_to_string(list_transform(string_split(role, ''), lambda x: ord(x)), ',') AS labels, repeat('0', turn::BIGINT) || repeat('1', length(role)) || '0' AS predict FROM conversations",
    "padded_batches": "WITH x AS (SELECT DISTINCT conv_id, turn FROM conversations), y AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) - turn AS room, range(1, turn + 2) AS ids FROM x) SELECT conv_id, turn, array_to_string(ids, ',') || repeat(',0', room) AS input_ids, array_to_string(list_transform(ids, lambda i: 1), ',') || repeat(',0', room) AS mask, array_to_string(ids, ',') || repeat(',-100', room) AS labels FROM y",
    "early_stop_scan": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id < 800 AND lang IN ('en', 'de') AND n_chars <= 2000 ORDER BY doc_id LIMIT 50",
    "difficulty_filter": "SELECT upper(substr(o_orderpriority, 3, 1)) || lower(substr(o_orderpriority, 4)) AS difficulty, count(*) AS n FROM orders WHERE lower(substr(o_orderpriority, 3)) IN ('urgent', 'low') GROUP BY 1",
    "seeded_shuffle": "SELECT doc_id, lang, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place FROM documents",
    "calibration_texts": "SELECT doc_id, n_chars FROM documents WHERE doc_id < 900 AND n_chars <= 1500 ORDER BY doc_id LIMIT 64",
    "event_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(strftime(ts, '%H:%M:%S')) AS first, max(strftime(ts, '%H:%M:%S')) AS last FROM events GROUP BY 1",
    "numeric_file_order": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1073741824 ELSE doc_id END::INT AS place FROM documents",
}
QUERIES = {name: globals()[name] for name in ORACLES}
