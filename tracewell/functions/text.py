"""Text functions as Spark expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.tokens import bound

#: How errors are told apart, in order: (category, alternatives, each of substrings that must all be there).
OUTCOMES = [
    ("syntax_error", [["SyntaxError"], ["IndentationError"]]),
    ("wrong_answer", [["AssertionError"]]),
    ("missing_function", [["NameError", "not defined"]]),
]


#: A fence, whatever follows its name, to the next one or the end.
FENCED = r"(?is)```(?:python|py\s)?\s*(.*?)(?:```|\z)"
DEFINED = r"(?sm)^((?:def|class) \w.*)"


def strip(text: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", "")


def strip_thinking(text: Column) -> Column:
    """What follows the first </think>, left-trimmed; the whole text without one."""
    at = F.instr(text, "</think>")
    return F.when(at > 0, F.regexp_replace(F.substring(text, at + 8, F.length(text)), r"^\s+", "")).otherwise(text)


def fenced_code(text: Column) -> Column:
    """Body of the first code fence, to its end or the text's; null without one."""
    body = F.regexp_extract(text, FENCED, 1)
    return F.when(text.rlike("```"), F.replace(body, F.lit("\t"), F.lit("    ")))


def unfenced_code(text: Column) -> Column:
    """From the first top-level def or class up to the first line that is no code, without trailing blank lines; empty if there is none.

    A line is code if it is empty or indented, or starts with def, class or @.
    """
    lines = F.split(F.regexp_extract(text, DEFINED, 1), "\n")
    end = F.array_position(F.transform(lines, lambda x: (x == "") | x.rlike(r"^([ \t]|def |class |@)")), False)
    kept = F.slice(lines, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(lines)).cast("int"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\s+\z", "")


def code_of(answer: Column) -> Column:
    """The code of an answer, before it is parsed: after the thinking, tabs as four spaces; the first fence from its first def or class on
    (all of it if it has none), or else the code lines."""
    body = strip(F.replace(strip_thinking(answer), F.lit("\t"), F.lit("    ")))
    fenced = strip(fenced_code(body))
    defined = F.regexp_extract(fenced, DEFINED, 1)
    return F.when(body.rlike("```"), F.when(defined != "", defined).otherwise(fenced)).otherwise(unfenced_code(body))


def render(template: str, text: Column) -> Column:
    """A prompt template with {text}."""
    head, _, tail = template.partition("{text}")
    return F.concat(F.lit(head), text, F.lit(tail))


def with_signature(prompt: Column, signature: Column) -> Column:
    """Append a fenced stub if there is a signature."""
    return F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.rtrim(prompt), F.lit("\n\n```python\n"), signature, F.lit("\n```"))).otherwise(prompt)


def with_suffixes(prompt: Column, **suffixes: tuple[Column, str]) -> Column:
    """Append each text whose condition holds, in order."""
    return F.concat_ws("\n", prompt, *[F.when(condition, F.lit(text)) for condition, text in suffixes.values()])


def chat(system: Column, user: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", system), message("user", user))


def entry_points(tests: Column) -> Column:
    """Function names that tests call, in order, without the placeholder `candidate`."""
    names = F.concat(F.regexp_extract_all(tests, F.lit(r"check\((\w+)\)"), 1), F.regexp_extract_all(tests, F.lit(r"assert (\w+)\("), 1))
    return F.array_distinct(F.filter(names, lambda x: x != "candidate"))


def trailing_name(entry: Column) -> Column:
    """Last word of a dotted entry point."""
    name = F.regexp_extract(entry, r"(\w+)$", 1)
    return F.when(name == "", entry).otherwise(name)


def outcome(status: Column, error: Column) -> Column:
    """Category of a run by its status (pass and timeout are categories themselves) and, for others, its error."""
    out = F.lit("runtime_error")
    for category, alternatives in reversed(OUTCOMES):
        hit = F.lit(False)
        for marks in alternatives:
            both = F.lit(True)
            for m in marks:
                both = both & F.contains(F.coalesce(error, F.lit("")), F.lit(m))
            hit = hit | both
        out = F.when(hit, category).otherwise(out)
    return F.when(status.isin("pass", "timeout"), status).otherwise(out)


def shingle_ratio(text: Column, width: int = 24) -> Column:
    """Distinct share of the first len - width character shingles (the last one is left out); 1 for texts shorter than two widths.

    An Arrow UDF: a JVM lambda is interpreted and builds an array of all shingles, where a set needs the distinct ones alone.
    """

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> float | None:
            n = len(t or "") - width
            return None if t is None else 1.0 if n < width else len({t[i : i + width] for i in range(n)}) / n

        return pd.Series([one(t) for t in texts], dtype="float64")

    return ratio(text)


def collapse(text: Column, clip: int | None = None) -> Column:
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(out, 1, clip) if clip else out


def label(text: Column) -> Column:
    """File-name form of a label: / and space to _, no parentheses."""
    return F.translate(text, "/ ()", "__")


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def fingerprint(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def clock(seconds: Column) -> Column:
    """12h 03m 04s."""
    s = seconds.cast("bigint")
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def name_part(name: Column, at: int) -> Column:
    """Part of a dotted name, from 0; negative from the end."""
    return F.try_element_at(F.split(name, r"\."), F.lit(at + 1 if at >= 0 else at))


def code_head(code: Column) -> Column:
    return F.substring(F.array_join(F.slice(F.split(code, "\n"), 1, 2), " "), 1, 160)


def byte_number(text: Column, name: str) -> Column:
    """The number after a JSON key in raw text."""
    return F.regexp_extract(text, rf'"{name}":\s*(\d+)', 1).try_cast("bigint")


FENCE_OPEN, FENCE_CLOSE, THINK_END = "```python", "```", "</think>"


def clean_trace(tokens: Column, bridges: dict[str, tuple[Column, Column]]) -> Column:
    """Cut a trace to its thinking and its first code fence with a bridge token between, or to the code alone where thinking does not precede it.

    `bridges` has under each name a column parallel to the tokens, and an array of the one element that stands for the bridge in it.
    Returns a struct of tokens and those columns, all cut alike (null ones stay null), and `found`: whether there was code to cut to. Character places become the
    first token that starts there or later. A trace without tokens or a closed fence stays as it is. Each step is computed once and passed on, so the work is linear in the tokens.
    """
    names = ["tokens", *bridges]
    parts = {"tokens": (tokens, F.array(F.lit("\n")))} | bridges
    same = F.struct(*[parts[n][0].alias(n) for n in names], F.lit(False).alias("found"))
    find = lambda part, text, start: F.call_function("locate", F.lit(part), text, start)

    def places(s: Column) -> Column:
        """How many characters stand before the fence, before what follows it, and before what follows the thinking; null where there is none."""
        opens, thought = F.nullif(s["opens"], F.lit(0)), F.nullif(s["thought"], F.lit(0))
        close = F.nullif(find(FENCE_CLOSE, s["text"], opens + len(FENCE_OPEN)), F.lit(0))
        return F.struct((opens - 1).alias("code"), (close - 1 + len(FENCE_CLOSE)).alias("stop"), F.when(thought < opens, thought - 1 + len(THINK_END)).alias("keep"))

    def counted(p: Column) -> Column:
        """One pass over the tokens: the number of those that start before each place."""
        def step(s: Column, token: Column) -> Column:
            more = lambda name: (s[name] + F.when(s["at"] < p[name], 1).otherwise(0)).alias(name)
            return F.struct((s["at"] + F.length(token)).alias("at"), more("code"), more("stop"), more("keep"))

        n = F.aggregate(tokens, F.struct(*[F.lit(0).alias(x) for x in ("at", "code", "stop", "keep")]), step)
        return F.when(p["stop"].isNotNull(), F.struct(n["code"].alias("code"), n["stop"].alias("stop"), F.when(p["keep"].isNotNull(), n["keep"]).alias("keep")))

    def cut(n: Column) -> Column:
        before = lambda v, bridge: F.when(n["keep"] < n["code"], F.concat(F.slice(v, F.lit(1), n["keep"]), bridge)).otherwise(F.slice(v, 1, 0))
        piece = F.struct(*[F.concat(before(v, bridge), F.slice(v, n["code"] + 1, n["stop"] - n["code"])).alias(name) for name, (v, bridge) in parts.items()], F.lit(True).alias("found"))
        return F.when(n["code"] < F.size(tokens), piece).otherwise(same)

    found = bound(F.array_join(tokens, ""), lambda text: F.struct(text.alias("text"), find(FENCE_OPEN, text, F.lit(1)).alias("opens"), find(THINK_END, text, F.lit(1)).alias("thought")))
    return F.coalesce(bound(bound(bound(found, places), counted), cut), same)


# Endings of the parameters that quantization adds to a layer.
QUANT_SUFFIXES = ["weight_scale", "weight_zero_point", "weight_g_idx", "weight_shape", "weight_packed", "input_scale", "input_zero_point"]


def ends_with_any(name: Column, suffixes: list[str]) -> Column:
    """Whether the name has one of the endings; false for null."""
    return F.coalesce(F.exists(F.array(*map(F.lit, suffixes)), lambda end: F.endswith(name, end)), F.lit(False))
