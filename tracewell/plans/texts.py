"""Text queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import source_code, text
from tracewell.plans.tables import table
from tracewell.sources import records

#: Errors whose marks collide.
_ERRORS = [
    "x: AssertionError", "AssertionError: NameError: name f is not defined", "NameError: name f is not defined", "NameError: free variable", "ValueError: timeout must be positive", "it is not defined",
    "IndentationError after AssertionError", "SyntaxError: NameError is not defined", "ZeroDivisionError", "",
]


def _answers(spark, d):
    """An answer, a test suite and an entry point for each document: by doc_id mod 4 a fence after thinking, code without a fence, a Solution class, and code that is cut off; every fifth suite does not parse."""
    n, body = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    answer = (
        F.when(F.col("doc_id") % 4 == 0, join("<think>", body, "</think>\n\n```python\ndef f", n, "(x):\n\treturn x + ", n, "\n```\n", body))
        .when(F.col("doc_id") % 4 == 1, join("Here it is:\ndef solveIt(a, b=", n, "):\n    return a + b\n\nSo the answer is this. ", body))
        .when(F.col("doc_id") % 4 == 2, join("```python\nclass Solution:\n    def __init__(self):\n        pass\n    def run(self, a):\n        return self.other(a)\n    def other(self, a):\n        return a * ", n, "\n```\n", body))
        .otherwise(join("```\nx = ", n, "\ny = (\n", body))
    )
    suite = F.when(F.col("doc_id") % 5 == 0, "not python (").otherwise(join("def check(candidate):\n    y = ", n, "\n    assert candidate(y) == ", n, "\n    assert candidate(3, k=y)\n"))
    calls = F.when(F.col("doc_id") % 3 == 0, join("check(f", n, ")")).when(F.col("doc_id") % 3 == 1, join("assert lang_", n, "(1, 2) == 3\nassert candidate(2) == 4")).otherwise(body)
    entry = F.when(F.col("doc_id") % 2 == 0, join("mod.f", n)).otherwise("solve_it")
    return table(spark, d, "documents").select("doc_id", answer.alias("answer"), suite.alias("suite"), calls.alias("calls"), entry.alias("entry"))


def strip_thinking(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\n  "), F.col("text"))).otherwise(F.col("text")).alias("t"))
    return rows.select("doc_id", text.strip_thinking(F.col("t")).alias("answer"))


def fence_extract(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x\n```Python"), F.when(F.col("doc_id") % 8 < 4, "\n\t").otherwise(" "), F.lit("y = 1\n\t"), F.col("text"), F.when(F.col("doc_id") % 4 == 0, "\n```\ny").otherwise(""))).otherwise(F.col("text")).alias("t"))
    return rows.select("doc_id", text.fenced_code(F.col("t")).alias("code"))


def prompt_render(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    prompt = text.with_signature(text.render("Solve:\n{text}\n", F.col("text")), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("def f"), F.col("turn").cast("string"), F.lit("():"))))
    prompt = text.with_suffixes(prompt, cp=(F.col("turn") > 2, "Read from stdin."), budget=(F.col("conv_id") % 3 == 0, "Be brief."))
    return rows.select("conv_id", "turn", prompt.alias("prompt"))


def chat_turn_assembly(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    messages = text.chat(F.lit("You solve tasks."), F.col("text"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


def classify_outcome(spark, d):
    error = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % len(_ERRORS) + 1).cast("int"))
    status = F.when(F.col("event_type") == "click", "pass").when(F.col("event_type") == "purchase", "timeout").otherwise("fail")
    return table(spark, d, "events").select("event_id", text.outcome(status, error).alias("outcome"))


def entry_point_names(spark, d):
    """Functions that a suite calls, and the last name of a dotted entry point."""
    return _answers(spark, d).select("doc_id", F.array_join(text.entry_points(F.col("calls")), ",").alias("names"), text.trailing_name(F.col("entry")).alias("entry"))


def row_normalization(spark, d):
    """Five fields: null to empty and trimmed, the entry point's last name; rows without text go."""
    padded = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit(" \n "), F.col("text"), F.lit("\t ")))
    fields = {"text": padded, "code": F.when(F.col("doc_id") % 3 != 0, F.col("text")), "test_cases": F.col("lang"), "entry_point": F.concat_ws(".", "lang", "source"), "difficulty": F.concat(F.lit(" "), F.col("source"))}
    rows = table(spark, d, "documents").select("doc_id", *[text.strip(F.coalesce(c, F.lit(""))).alias(n) for n, c in fields.items()])
    return rows.where("text <> ''").withColumn("entry_point", text.trailing_name(F.col("entry_point")))


def shingle_ratio(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.shingle_ratio(F.col("text")).alias("x"))
    return rows.select("doc_id", F.round("x", 6).alias("ratio"), (F.col("x") < 0.6).alias("degenerate"))


def text_forms(spark, d):
    """Collapsing, labels, hashes, fingerprints, clocks, name parts, code heads."""
    rows = table(spark, d, "documents")
    name = F.concat_ws(".", F.lit("model"), F.lit("layers"), (F.col("doc_id") % 28).cast("string"), F.col("lang"), F.lit("weight"))
    return rows.select(
        "doc_id", text.collapse(F.col("text"), 300).alias("clip"), text.label(F.concat(F.col("source"), F.lit(" (a)/b"))).alias("label"), text.short_hash(F.col("text")).alias("hash"),
        text.fingerprint(F.col("source"), F.col("n_chars")).alias("fingerprint"), text.clock(F.col("n_chars") * 7).alias("clock"),
        text.name_part(name, 2).alias("layer"), text.name_part(name, -2).alias("proj"), text.code_head(F.col("text")).alias("head"),
    )


def name_filter(spark, d):
    """Weight names by prefix, suffix and projection type, ordered by layer and projection."""
    kinds = ["q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj"]
    kind = F.element_at(F.array(*map(F.lit, [*kinds, "norm"])), ((F.col("p_partkey") % 8) + 1).cast("int"))
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "lm.").otherwise("model.layers."), (F.col("p_partkey") % 28).cast("string"), F.lit("."), kind, F.when(F.col("p_partkey") % 5 == 0, ".bias").otherwise(".weight"))
    rows = table(spark, d, "part").select("p_partkey", name.alias("name"))
    rows = rows.where(F.col("name").startswith("model.layers.") & F.col("name").endswith(".weight") & text.name_part(F.col("name"), -2).isin(kinds))
    return rows.select("p_partkey", text.name_part(F.col("name"), 2).cast("int").alias("layer"), text.name_part(F.col("name"), -2).alias("proj")).orderBy("layer", "proj", "p_partkey")


def quant_suffixes(spark, d):
    """Parameters that quantization added, and those that stay, by layer."""
    ends = ["weight", "bias", *text.QUANT_SUFFIXES]
    name = F.concat(F.lit("model.layers."), (F.col("p_partkey") % 28).cast("string"), F.lit(".mlp."), F.element_at(F.array(*map(F.lit, ends)), (F.col("p_partkey") % 9 + 1).cast("int")), F.when(F.col("p_size") > 45, "s").otherwise(""))
    rows = table(spark, d, "part").select(name.alias("name"), text.ends_with_any(name, text.QUANT_SUFFIXES).alias("added"))
    return rows.groupBy(text.name_part(F.col("name"), 2).cast("int").alias("layer")).agg(F.count_if("added").alias("removed"), F.count_if(~F.col("added")).alias("kept"), F.max(F.when(~F.col("added"), F.col("name"))).alias("last_kept"))


def json_lines(spark, d):
    """Parse event properties permissively: bad lines become null and are dropped; numbers also by pattern from the raw text."""
    raw = F.when(F.col("event_id") % 9 == 0, F.lit("{bad")).otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("k", F.from_json("raw", "k bigint")["k"])
    return rows.where("k is not null").select("event_id", "k", text.byte_number(F.col("raw"), "k").alias("by_pattern"))


def first_failures(spark, d):
    """First non-pass category and first non-empty error of a user's events, with defaults."""
    first = lambda c, test: F.min_by(F.when(test, F.col(c)), F.when(test, F.col("event_id")))
    failed, told = ~F.col("event_type").isin("click", "view"), F.length("props") > 8
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(first("event_type", failed), F.lit("?")).alias("category"), F.coalesce(first("props", told), F.lit("")).alias("error"))


def missing_index_fill(spark, d):
    """Absent results of a sequence of tests count as timeouts. One aggregation of both tables by problem: no row is made for each test, and nothing is sorted for a join."""
    tests, status = range(1, 6), F.col("l_linestatus")
    rank = F.when(status > "O", 3).when(status == "O", 2).when(status < "O", 1).cast("tinyint")  # in the order of the statuses, so that the greatest decides
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.lit(1).alias("n"), *[F.lit(None).cast("tinyint").alias(f"t{k}") for k in tests])
    got = table(spark, d, "lineitem").where("l_orderkey is not null and l_linenumber between 1 and 5 and l_linestatus is not null")
    got = got.select(F.col("l_orderkey").alias("idx"), F.lit(0).alias("n"), *[F.when(F.col("l_linenumber") == k, rank).alias(f"t{k}") for k in tests])
    rows = wanted.unionAll(got).groupBy("idx").agg(F.sum("n").alias("n"), *[F.max(f"t{k}").alias(f"t{k}") for k in tests]).where("n > 0")
    of = lambda test: sum((F.coalesce(test(F.col(f"t{k}")), F.lit(False)).cast("bigint") for k in tests), F.lit(0).cast("bigint")) * F.col("n")
    return rows.select("idx", of(lambda t: t == 2).alias("passed"), of(F.isnull).alias("timeouts"))


def trace_cleaning(spark, d):
    """Whole documents as traces, of which a third has thinking before the code, a third code alone and a third no fence; the parallel arrays are cut too (tested against a brute-force version: SQL cannot split before a token)."""
    fence = F.concat(F.lit("\n```python\nx = 1\n"), F.col("text"), F.lit("\n```\nThat is all."))
    whole = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think> "), F.col("text"), F.lit("</think>\n So "), fence)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("So "), fence)).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", "text", F.split(whole, "(?<=\\s)").alias("tokens"))
    rows = rows.select("doc_id", "text", "tokens", F.transform("tokens", lambda t: F.create_map(t, F.lit(-0.5).cast("double"))).alias("logprobs"), F.transform("tokens", lambda t: F.array(F.length(t))).alias("top_k_ids"), F.transform("tokens", lambda t: F.array(F.lit(-0.5).cast("double"))).alias("top_k_vals"))
    return records.cleaned(rows).select("doc_id", "text", F.size("tokens").alias("tokens"), F.size("logprobs").alias("logprobs"), F.size("top_k_ids").alias("top_k_ids"), F.size("top_k_vals").alias("top_k_vals"))


def token_remap(spark, d):
    """Token ids of one vocabulary to another by a mapping table; ids without a single-token counterpart go."""
    mapping = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") * 2 + 1).alias("new_id"))
    rows = table(spark, d, "lineitem").join(mapping, "l_partkey")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.sum("new_id").alias("ids"))


def code_tools(spark, d):
    """Parsing of source text: prefixes, unwrapping, tests, signatures, aliases, instrumentation (tested against expected texts: SQL has no parser)."""
    rows = _answers(spark, d).select("doc_id", text.code_of(F.col("answer")).alias("code"), "suite", text.trailing_name(F.col("entry")).alias("name"))
    use, c = source_code.apply, source_code
    return rows.select(
        "doc_id", use(c.largest_prefix, "code").alias("prefix"), use(c.unwrap, "code").alias("unwrapped"), F.array_join(use(c.split_tests, "suite", "name", kind="array<string>"), "\n--\n").alias("cases"),
        use(c.call_signature, "suite", "name").alias("called"), use(c.definition_signature, "code", "name").alias("defined"), use(c.alias, "code", "name").alias("bound"), use(c.report, "suite").alias("instrumented"),
    )


def code_extraction(spark, d):
    """An answer's code, the largest prefix that parses, out of its Solution class (tested against expected texts)."""
    return _answers(spark, d).select("doc_id", source_code.apply(source_code.unwrap, text.code_of(F.col("answer"))).alias("code"))


ORACLES = {
    "strip_thinking": r"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<think>' || text || '</think>' || chr(10) || '  ' || text ELSE text END AS t FROM documents) SELECT doc_id, CASE WHEN strpos(t, '</think>') > 0 THEN regexp_replace(substr(t, strpos(t, '</think>') + 8), '^\s+', '') ELSE t END AS answer FROM t",
    "fence_extract": r"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x' || chr(10) || '```Python' || CASE WHEN doc_id % 8 < 4 THEN chr(10) || chr(9) ELSE ' ' END || 'y = 1' || chr(10) || chr(9) || text || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '```' || chr(10) || 'y' ELSE '' END ELSE text END AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, '```') THEN replace(regexp_extract(t, '(?is)```(?:python|py\s)?\s*(.*?)(?:```|\z)', 1), chr(9), '    ') END AS code FROM t",
    "prompt_render": "SELECT conv_id, turn, (CASE WHEN turn % 2 = 0 THEN rtrim('Solve:' || chr(10) || text || chr(10), ' ') || chr(10) || chr(10) || '```python' || chr(10) || 'def f' || turn || '():' || chr(10) || '```' ELSE 'Solve:' || chr(10) || text || chr(10) END) || CASE WHEN turn > 2 THEN chr(10) || 'Read from stdin.' ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN chr(10) || 'Be brief.' ELSE '' END AS prompt FROM conversations WHERE role = 'user'",
    "chat_turn_assembly": "SELECT conv_id, turn, 'system: You solve tasks.' || chr(10) || 'user: ' || text AS messages FROM conversations WHERE role = 'user'",
    "classify_outcome": f"WITH t AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'pass' WHEN 'purchase' THEN 'timeout' ELSE 'fail' END AS s, {_ERRORS}[event_id % {len(_ERRORS)} + 1] AS e FROM events) SELECT event_id, CASE WHEN s <> 'fail' THEN s WHEN contains(e, 'SyntaxError') OR contains(e, 'IndentationError') THEN 'syntax_error' WHEN contains(e, 'AssertionError') THEN 'wrong_answer' WHEN contains(e, 'NameError') AND contains(e, 'not defined') THEN 'missing_function' ELSE 'runtime_error' END AS outcome FROM t",
    "entry_point_names": r"WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'check(f' || doc_id || ')' WHEN 1 THEN 'assert lang_' || doc_id || '(1, 2) == 3' || chr(10) || 'assert candidate(2) == 4' ELSE coalesce(text, '') END AS calls FROM documents) SELECT doc_id, array_to_string(list_filter(list_distinct(list_concat(regexp_extract_all(calls, 'check\((\w+)\)', 1), regexp_extract_all(calls, 'assert (\w+)\(', 1))), lambda x: x <> 'candidate'), ',') AS names, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id ELSE 'solve_it' END AS entry FROM t",
    "row_normalization": r"WITH t AS (SELECT doc_id, regexp_replace(coalesce(CASE WHEN doc_id % 5 <> 0 THEN ' ' || chr(10) || ' ' || text || chr(9) || ' ' END, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g') AS text, regexp_replace(coalesce(CASE WHEN doc_id % 3 <> 0 THEN text END, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g') AS code, regexp_replace(coalesce(lang, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g') AS test_cases, concat_ws('.', lang, source) AS entry_point, regexp_replace(coalesce(' ' || source, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g') AS difficulty FROM documents) SELECT doc_id, text, code, test_cases, CASE WHEN regexp_extract(entry_point, '(\w+)$', 1) = '' THEN entry_point ELSE regexp_extract(entry_point, '(\w+)$', 1) END AS entry_point, difficulty FROM t WHERE text <> ''",
    "shingle_ratio": "WITH r AS (SELECT doc_id, CASE WHEN length(text) < 48 THEN 1.0 ELSE len(list_distinct(list_transform(range(1, length(text) - 23), lambda i: substr(text, i, 24))))::DOUBLE / (length(text) - 24) END AS x FROM documents) SELECT doc_id, round(x, 6) AS ratio, x < 0.6::DOUBLE AS degenerate FROM r",
    "text_forms": r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 300) AS clip, replace(source, ' ', '_') || '_a_b' AS label, substr(md5(text), 1, 8) AS hash, source || ':' || n_chars AS fingerprint, printf('%dh %02dm %02ds', n_chars * 7 // 3600, n_chars * 7 % 3600 // 60, n_chars * 7 % 60) AS clock, (doc_id % 28)::VARCHAR AS layer, lang AS proj, substr(array_to_string(string_split(text, chr(10))[1:2], ' '), 1, 160) AS head FROM documents",
    "name_filter": "SELECT p_partkey, (p_partkey % 28)::INT AS layer, ['q_proj', 'k_proj', 'v_proj', 'o_proj', 'gate_proj', 'up_proj', 'down_proj', 'norm'][(p_partkey % 8) + 1] AS proj FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 8 <> 7",
    "quant_suffixes": """WITH e AS (SELECT p_partkey % 28 AS layer, ['weight', 'bias', 'weight_scale', 'weight_zero_point', 'weight_g_idx', 'weight_shape', 'weight_packed', 'input_scale', 'input_zero_point'][p_partkey % 9 + 1] || CASE WHEN p_size > 45 THEN 's' ELSE '' END AS tail FROM part),
a AS (SELECT layer, 'model.layers.' || layer || '.mlp.' || tail AS name, tail IN ('weight_scale', 'weight_zero_point', 'weight_g_idx', 'weight_shape', 'weight_packed', 'input_scale', 'input_zero_point') AS added FROM e)
SELECT layer::INT AS layer, count(*) FILTER (added) AS removed, count(*) FILTER (NOT added) AS kept, max(name) FILTER (NOT added) AS last_kept FROM a GROUP BY layer""",
    "json_lines": r"""SELECT event_id, (props->>'k')::BIGINT AS k, regexp_extract(props, '"k":\s*(\d+)', 1)::BIGINT AS by_pattern FROM events WHERE event_id % 9 <> 0""",
    "first_failures": "SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (event_type NOT IN ('click', 'view')), '?') AS category, coalesce(arg_min(props, event_id) FILTER (length(props) > 8), '') AS error FROM events GROUP BY user_id",
    "missing_index_fill": "WITH w AS (SELECT o_orderkey AS idx, test FROM orders, range(1, 6) r(test)), g AS (SELECT l_orderkey AS idx, l_linenumber AS test, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2) SELECT idx, count(*) FILTER (s = 'O') AS passed, count(*) FILTER (s IS NULL) AS timeouts FROM w LEFT JOIN g USING (idx, test) GROUP BY idx",
    "token_remap": "SELECT l_orderkey, count(*) AS kept, sum(l_partkey * 2 + 1)::BIGINT AS ids FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0) GROUP BY l_orderkey",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "trace_cleaning", "code_tools", "code_extraction"]}
