"""Queries that SQL cannot express, over a whole table, against versions written apart."""

import pytest
from pyspark.sql import functions as F
from test_sources import _cleaned

from tracewell import plans
from tracewell.plans.tables import table
from tracewell.sources import records

QUERIES = plans.queries()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}


def _tokens(text):
    """Split after each white-space character, as a tokenizer would."""
    out, start = [], 0
    for i, c in enumerate(text):
        if c in " \t\n\x0b\f\r":
            out.append(text[start : i + 1])
            start = i + 1
    return out + [text[start:]]


def test_trace_cleaning(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in QUERIES["trace_cleaning"](spark, sf_dir).collect()}
    assert set(got) == set(documents)
    for i, text in documents.items():
        fence = f"\n```python\nx = 1\n{text}\n```\nThat is all."
        whole = [f"<think> {text}</think>\n So {fence}", f"So {fence}", text][i % 3]
        tokens, r = _tokens(whole), got[i]
        kept = _cleaned_fast(tokens)
        assert r["tokens"] == r["logprobs"] == r["top_k_ids"] == r["top_k_vals"] == (len(tokens) if kept is None else len(kept))
        assert r["text"] == (text if kept is None else "".join("\n" if k is None else tokens[k] for k in kept))


def _cleaned_fast(tokens):
    """_cleaned, with sums that are kept."""
    if len(tokens) < 60:
        return _cleaned(tokens)
    at, n = [], 0
    for t in tokens:
        at.append(n)
        n += len(t)
    text = "".join(tokens)
    opens, thought = text.find("```python"), text.find("</think>")
    ends = text.find("```", opens + 9) if opens >= 0 else -1
    if ends < 0:
        return None
    first = lambda place: next((i for i, x in enumerate(at) if x >= place), len(at))
    code, stop = first(opens), first(ends + 3)
    keep = first(thought + 8) if 0 <= thought < opens else code
    return None if code == len(at) else ([*range(keep), None] if keep < code else []) + list(range(code, stop))


def test_a_trace_of_100000_tokens(spark):
    tokens = ["think "] * 50_000 + ["</think>", "so ", "```python\n"] + ["x = 1\n"] * 49_000 + ["```", " end"]
    rows = spark.range(1).select(F.array_repeat(F.lit("think "), 50_000).alias("a"), F.array_repeat(F.lit("x = 1\n"), 49_000).alias("b"))
    rows = rows.select(F.lit("raw").alias("text"), F.concat("a", F.array(*map(F.lit, tokens[50_000:50_003])), "b", F.array(F.lit("```"), F.lit(" end"))).alias("tokens"))
    rows = rows.withColumns({"logprobs": F.transform("tokens", lambda t: F.create_map(t, F.lit(1.0))), "top_k_ids": F.transform("tokens", lambda t, i: F.array(i)), "top_k_vals": F.lit(None).cast("array<array<double>>")})
    row = records.cleaned(rows).select("tokens", F.size("logprobs").alias("n"), F.element_at("top_k_ids", 50_003).alias("at"), F.col("top_k_vals").isNull().alias("none")).first()
    kept = _cleaned_fast(tokens)
    assert row["tokens"] == ["\n" if k is None else tokens[k] for k in kept] and row["n"] == len(kept) and row["at"] == [kept[50_002]] and row["none"]


def _wanted(i):
    """The code of answer i, parsed and out of its class."""
    return [f"def f{i}(x):\n    return x + {i}", f"def solveIt(a, b={i}):\n    return a + b", f"def run(a):\n    return other(a)\n\ndef other(a):\n    return a * {i}", f"x = {i}"][i % 4]


def test_code_extraction(spark, sf_dir, documents):
    got = {r["doc_id"]: r["code"] for r in QUERIES["code_extraction"](spark, sf_dir).collect()}
    assert got == {i: _wanted(i) for i in documents}


def test_code_tools(spark, sf_dir, documents):
    for r in QUERIES["code_tools"](spark, sf_dir).collect():
        i = r["doc_id"]
        name = f"f{i}" if i % 2 == 0 else "solve_it"
        whole = f"class Solution:\n\n    def __init__(self):\n        pass\n\n    def run(self, a):\n        return self.other(a)\n\n    def other(self, a):\n        return a * {i}".replace("\n\n", "\n")
        assert r["unwrapped"] == _wanted(i) and r["prefix"] == (whole if i % 4 == 2 else _wanted(i))
        heads = [f"def f{i}(x):", f"def solveIt(a, b={i}):", "def other(self, a):", ""]
        assert r["defined"] == heads[i % 4]
        if i % 4 == 0:
            assert r["bound"] == r["prefix"]
        elif i % 4 == 1:
            assert r["bound"] == f"{r['prefix']}\nsolve_it = solveIt\n"
        if i % 5 == 0:
            assert r["cases"] == "" and r["called"] == "" and r["instrumented"] == "not python ("
            continue
        parts = [f"y = {i}", f"assert candidate(y) == {i}", "assert candidate(3, k=y)"]
        assert r["cases"].split("\n--\n") == [f"def check(candidate):\n    {p}\ncheck({name})" for p in parts]
        assert r["called"] == f"def {name}(arg0, k):"
        space = {}
        exec(r["instrumented"], space)
        space["check"](lambda y, k=None: i or 1)
        with pytest.raises(AssertionError, match=r"candidate\(3, k=y\)"):
            space["check"](lambda y, k=None: i if k is None else 0)
