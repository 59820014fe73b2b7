"""Scans of record files. Small files come many to a partition from `file_ends`, which lists folders in the tasks; logs of lines come from Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions.text import clean_trace
from tracewell.operators.evaluate import fully_passed
from tracewell.sources.file_ends import file_ends, whole_files


def _json(rows: DataFrame, schema: str, *keep: str) -> DataFrame:
    """The fields of files (stem, value) that are one JSON document each, in UTF-8; empty files have none. Generated, so that filters on the fields do not parse again."""
    text = F.when(F.is_valid_utf8("value"), F.ltrim(F.col("value"), F.lit("\ufeff"))).otherwise("no UTF-8")
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.where(F.col("value").rlike(r"\S")).select(*keep, F.inline(F.array(parsed)))


def keyed_json(spark: SparkSession, folder: str, schema: str, numeric: bool = True) -> DataFrame:
    """One JSON document per file, keyed by the file's stem as idx; unreadable files have _corrupt. Files may lie in folders of the folder."""
    rows = whole_files(spark, folder, ".json" if numeric else "")
    if numeric:
        rows = rows.where(F.col("stem").rlike("^[0-9]"))
    return _json(rows, schema + ", _corrupt string", "stem").withColumn("idx", F.col("stem").try_cast("bigint")).drop("stem")


def cleaned(rows: DataFrame) -> DataFrame:
    """Traces whose tokens, logprobs and top-k columns are cut by `clean_trace`; the text is the tokens' where there was code to cut to."""
    bridges = {"logprobs": F.array(F.create_map().cast("map<string, double>")), "top_k_ids": F.array(F.array().cast("array<int>")), "top_k_vals": F.array(F.array().cast("array<double>"))}
    rows = rows.withColumn("_cut", clean_trace(F.col("tokens"), {n: (F.col(n), b) for n, b in bridges.items()}))
    text = F.when(F.col("_cut.found"), F.array_join("_cut.tokens", "")).otherwise(F.col("text"))
    return rows.withColumns({"text": text, **{n: F.col(f"_cut.{n}") for n in ["tokens", *bridges]}}).drop("_cut")


def traces(spark: SparkSession, folder: str, require_passing: bool = True) -> DataFrame:
    """Keyed traces: readable, fully passed if asked for, cleaned, with a non-blank text."""
    rows = keyed_json(spark, folder, schemas.TRACE).where("_corrupt is null").drop("_corrupt")
    if require_passing:
        rows = rows.where(fully_passed(F.col("test_passed"), F.col("test_total")))
    rows = cleaned(rows)
    return rows.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def lookup(spark: SparkSession, folder: str, idx: int) -> DataFrame:
    """The cleaned trace of one key: no rows if there is none. Only the one file is opened."""
    rows = whole_files(spark, folder, ".json").where(F.col("stem") == str(int(idx)))
    return cleaned(_json(rows, schemas.TRACE)).withColumn("idx", F.lit(idx).cast("bigint"))


def short_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Several texts per key, exploded with their position; keys without texts go."""
    rows = keyed_json(spark, folder, schemas.SHORT_TRACE).where("_corrupt is null and size(texts) > 0")
    return rows.select("idx", "prompt", F.posexplode("texts").alias("sample", "text"))


def eval_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record, idx, solved) of all compact evaluation records of a folder."""
    rows = _json(whole_files(spark, folder, ".json"), schemas.EVAL_RECORD, "stem")
    return rows.select(F.col("stem").alias("record"), F.explode("per_problem").alias("p")).select("record", "p.idx", "p.solved")


def plus_results(spark: SparkSession, path: str) -> DataFrame:
    """task -> whether its first sample passed."""
    rows = _json(whole_files(spark, path), schemas.PLUS_RESULTS)
    return rows.select(F.explode("eval").alias("task", "samples")).select("task", (F.try_element_at("samples", F.lit(1))["plus_status"] == "pass").alias("solved"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids from a JSON file that is a list of numbers, a list of objects with idx or id, or an object with such a list under a known key."""
    rows = whole_files(spark, path).select(F.try_parse_json("value").alias("v"))
    found = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("ids", "idx", "indices", "problems", "broken")], F.try_variant_get("v", "$", "array<variant>"))
    one = lambda x: F.coalesce(F.try_variant_get(x, "$.idx", "bigint"), F.try_variant_get(x, "$.id", "bigint"), F.try_variant_get(x, "$", "bigint"))
    return rows.select(F.explode(found).alias("x")).select(one(F.col("x")).alias("idx")).where("idx is not null").distinct()


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, key, value, kind) of settings files: `key: value` lines, indented below a `section:` line or at the top level (section '').

    Comments, blank lines and quotes around a value go. kind is null, bool, int, float or str, as YAML reads plain values; value is its text, null for null.
    Sections in sections and lists are not read. A file is one row, so files are as small as settings are.
    """
    rows = whole_files(spark, path).select(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("file"), F.split("value", r"\r?\n").alias("lines"))
    head = r"^([^\s:]+):\s*(?:#.*)?$"
    place = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<section:string,line:string>>").alias("out"))
    step = lambda s, line: F.when(F.rlike(line, F.lit(head)), F.struct(F.regexp_extract(line, head, 1).alias("section"), s["out"].alias("out"))).otherwise(
        F.struct(s["section"].alias("section"), F.array_append(s["out"], F.struct(F.when(F.rlike(line, F.lit(r"^\s")), s["section"]).otherwise("").alias("section"), line.alias("line"))).alias("out"))
    )
    kept = F.filter("lines", lambda line: F.rlike(line, F.lit(r"^\s*[^\s#]")))
    rows = rows.select("file", F.explode(F.aggregate(kept, place, step, lambda s: s["out"])).alias("x")).select("file", "x.section", F.regexp_extract("x.line", r"^\s*([^\s:]+):", 1).alias("key"), F.trim(F.regexp_extract("x.line", r"""^\s*[^\s:]+:\s*("[^"]*"|'[^']*'|.*?)(?:\s+#.*)?\s*$""", 1)).alias("raw"))
    raw, quoted = F.col("raw"), F.col("raw").rlike(r"""^(".*"|'.*')$""")
    kind = F.when(quoted, "str").when(raw.rlike("^(|~|null|Null|NULL)$"), "null").when(raw.rlike("^(true|True|TRUE|false|False|FALSE)$"), "bool").when(raw.rlike(r"^[-+]?[0-9]+$"), "int").when(raw.rlike(r"^[-+]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+][0-9]+)?$"), "float").otherwise("str")
    value = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).when(kind == "bool", F.lower(raw)).when(kind != "null", raw)
    return rows.where("key <> ''").select("file", "section", "key", value.alias("value"), kind.alias("kind"))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSONL logs of any generation; lines that do not parse go."""
    return spark.read.schema(schemas.RUN_EVENT + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null and kind is not null").drop("_corrupt")


def _text(raw: str) -> Column:
    """Bytes as text; a character that the cut has halved becomes a replacement sign."""
    return F.make_valid_utf8(F.col(raw).cast("string"))


def _number(text: Column, key: str) -> Column:
    return F.regexp_extract(text, rf'"{key}":\s*(\d+)', 1).try_cast("int").alias(key)


def complete(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each file ends as JSON does: with } or a line end. One byte of each is read."""
    return file_ends(spark, folder, tail=1).select("stem", _text("tail").isin("}", "\n").alias("complete"))


def tail_counts(spark: SparkSession, folder: str, tail: int = 400) -> DataFrame:
    """Pass counts from the last bytes of large JSON files, without reading their arrays."""
    rows = file_ends(spark, folder, tail=tail).where(F.col("stem").rlike("^[0-9]"))
    return rows.select(F.col("stem").try_cast("bigint").alias("idx"), _number(_text("tail"), "test_passed"), _number(_text("tail"), "test_total"))


def cache_probe(spark: SparkSession, folder: str, prompts: DataFrame, max_tokens: int, require_passing: bool = True, head: int = 512, tail: int = 400) -> DataFrame:
    """(idx, valid): whether a cached trace may be kept, from its two ends alone. prompts: idx, prompt.

    Its prompt begins as the expected one does (as much of it as the head holds), it has tokens, it passed all its tests or need not, or else was
    allowed as many tokens as now; null pass counts do not pass. Files without an expected prompt are not valid.
    """
    rows = file_ends(spark, folder, head, tail).where(F.col("stem").rlike("^[0-9]")).select(F.col("stem").try_cast("bigint").alias("idx"), _text("head").alias("head"), _text("tail").alias("tail"))
    told = F.regexp_extract("head", r'(?s)^\{\s*"prompt":\s*"((?:[^"\\]|\\.)*+)', 1)
    want = F.regexp_extract(F.to_json(F.struct("prompt")), r'(?s)^\{"prompt":"(.*)"\}\z', 1)
    rows = rows.join(prompts.select("idx", want.alias("want")), "idx", "left")
    # A whole prompt ends with a quote within the head; of a longer one the head holds the beginning.
    same = F.when(F.col("head").rlike(r'(?s)^\{\s*"prompt":\s*"(?:[^"\\]|\\.)*+"'), told == F.col("want")).otherwise(F.startswith("want", told) & (told != ""))
    passed = _number(F.col("tail"), "test_passed") == _number(F.col("tail"), "test_total")
    tokens = ~F.concat("head", "tail").rlike(r'"tokens":\s*\[\s*\]')
    allowed = F.lit(True) if not require_passing else passed | (_number(F.col("head"), "max_tokens") >= max_tokens)
    return rows.select("idx", F.coalesce(same & tokens & allowed, F.lit(False)).alias("valid"))


def report_lines(spark: SparkSession, path: str) -> DataFrame:
    """Per-problem `n/5 samples passed` lines of a Markdown report."""
    found = F.regexp_extract_all("value", F.lit(r"(?i)problem\s+(\d+)[^\n]*?(\d+)/5 samples passed"), 1)
    counts = F.regexp_extract_all("value", F.lit(r"(?i)problem\s+(\d+)[^\n]*?(\d+)/5 samples passed"), 2)
    rows = whole_files(spark, path).select(F.explode(F.arrays_zip(found.alias("idx"), counts.alias("n"))).alias("z"))
    return rows.select(F.col("z.idx").cast("bigint").alias("idx"), F.col("z.n").cast("int").alias("passed"))


def folder_size(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """Bytes by suffix; contents are not read, only listings, which tasks make of the folders in the folder."""
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    return file_ends(spark, folder, tail=0, suffix="").where(suffix.isin(suffixes)).groupBy(suffix.alias("suffix")).agg(F.sum("length").alias("bytes"))
