"""License scan: fixed phrases, and an exact set-similarity join of text blocks with templates.

A block is a sentence, whatever lines it is wrapped over. It matches a template when it contains at least `THRESHOLD` of
the template's distinct words, all of those that tell the template from others among them, and none that only another
license has. The join is the prefix-filter kind: words are put in one global order, rarest in the corpus
first; a block that shares enough words with a template must share one within the prefixes of both,
must have enough words at all (length filter), and must have enough words left after the first one
shared (positional filter). What passes is verified on the full sets, so the result is exact. The
templates are a bounded parameter and become literals of the plan: no row moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases that a scan always reports, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening sentences and short forms of public license notices: what a block must contain most of, the words of it that
#: it must contain, and words that it must not.
TEMPLATES = {
    "agpl-3.0": ("this work is licensed under the gnu affero general public license version 3", "gnu affero 3", ""),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache 2 0", ""),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution source binary", ""),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc", ""),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", "gnu general 2", "affero lesser library 3"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "gnu general 3", "affero lesser library"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission distribute fee", ""),
    "lgpl-3.0": ("this work is licensed under the gnu lesser general public license version 3", "gnu lesser 3", ""),
    "mit": ("released under the mit license", "released mit license", ""),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission charge copy", ""),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2 0", ""),
}
#: A sentence ends at one of .!? before white space and a capital, or at an empty line.
_SENTENCE_END, _EMPTY_LINE = r"([.!?])[\x20\x09-\x0D]+([A-Z])", r"\n[\x20\x09\x0B-\x0D]*\n"
THRESHOLD = 0.8
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """Lower-case A-Z. Of other letters only U+0130 and U+212A would turn into ASCII ones by lower(); elsewhere its
    changes keep non-ASCII letters so, which neither word breaks nor ASCII phrases and templates can see."""
    return F.when(F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K")), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _spaces(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first by the number of documents of the whole corpus that hold a word."""
    words = F.split(F.regexp_replace(_lower(F.coalesce("text", F.lit(""))), _BREAKS, " "), " ")
    found = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in found.collect()}  # a row for each word of the templates at most
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _containment(block: Column, order: list[str], template: set[str], needed: set[str], foreign: set[str], threshold: float) -> Column:
    """Share of the template's words in `block`, an array in global order; 0 below the threshold, or if a needed word is missing or a foreign one there."""
    mine = [w for w in order if w in template]
    need = math.ceil(threshold * len(mine) - 1e-9)
    here = F.array(*map(F.lit, mine))
    shared = F.array_intersect(block, here)
    passes = (
        (F.size(block) >= need)
        & F.arrays_overlap(F.slice(block, 1, F.greatest(F.size(block) - need + 1, F.lit(0))), F.array(*map(F.lit, mine[: len(mine) - need + 1])))
        & (1 + F.least(F.size(block) - F.array_position(block, F.try_element_at(shared, F.lit(1))), len(mine) - F.array_position(here, F.try_element_at(shared, F.lit(1)))) >= need)
    )
    told = F.size(F.array_intersect(block, F.array(*map(F.lit, sorted(needed))))) == len(needed)
    if foreign:
        told = told & ~F.arrays_overlap(block, F.array(*map(F.lit, sorted(foreign))))
    return F.when(passes & (F.size(shared) >= need) & told, F.size(shared) / F.lit(float(len(mine)))).otherwise(F.lit(0.0))


def _contained_in(template: tuple[set[str], set[str], set[str]], order: list[str], threshold: float):
    return lambda block: _containment(block, order, *template, threshold)


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Scan every whole text of `docs` (doc_id, text; others are ignored).

    `templates` has, by label, a notice, the words of it that must be there, and words that must not.

    Returns doc_id, n_words, n_base, first_word, last_word (word places of the phrases, from 0),
    base_labels, labels (the templates' too), score: 1 if a phrase occurs, else the largest verified
    containment. Null and empty texts have no words, null places, empty labels and score 0. Repeated
    rows are scanned alike.
    """
    templates = TEMPLATES if templates is None else templates
    parts = {label: tuple(set(x.split()) for x in t) for label, t in sorted(templates.items())}
    sets = {label: t[0] for label, t in parts.items()}
    order = word_order(docs, sorted(set().union(*(x for t in parts.values() for x in t))))
    rare = {w for t in sets.values() for w in [x for x in order if x in t][: len(t) - math.ceil(threshold * len(t) - 1e-9) + 1]}

    lowered = _lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", "text", F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, _BREAKS, " ")), F.lit(" ")).alias("flat"))
    flat = F.col("flat")
    counts = {p: F.regexp_count(flat, F.lit(f" {p}(?= )")) for p in PHRASES}
    rows = rows.select("doc_id", "text", "flat", F.when(F.char_length(flat) > 2, _spaces(flat) - 1).otherwise(0).cast("long").alias("n_words"), *[c.alias(f"n_{i}") for i, c in enumerate(counts.values())])
    firsts, lasts = [], []
    for i, p in enumerate(PHRASES):
        ahead = F.substring(flat, F.lit(1), F.instr(flat, f" {p} "))
        firsts.append(F.when(F.col(f"n_{i}") > 0, _spaces(ahead) - 1))
        behind = F.regexp_extract(flat, f"(?s)^(.*) {p} ", 1)
        lasts.append(F.when(F.col(f"n_{i}") > 0, _spaces(behind)))
    base = F.array_compact(F.array(*[F.when(F.col(f"n_{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))

    vocabulary = F.array(*map(F.lit, order))
    # Only evaluated for suspects: sentences are found before capitals go.
    sentences = F.filter(
        F.transform(F.split(F.regexp_replace("text", _SENTENCE_END, "$1\n\n$2"), _EMPTY_LINE), lambda block: F.array_intersect(vocabulary, F.split(_lower(block), _BREAKS))),
        lambda block: F.size(block) >= min(math.ceil(threshold * len(t) - 1e-9) for t in sets.values()),
    )
    suspect = flat.rlike(" (" + "|".join(sorted(rare)) + ") ")
    blocks = F.when(suspect, sentences).otherwise(F.array().cast("array<array<string>>"))
    rows = rows.select("doc_id", "n_words", (F.col("n_0") + F.col("n_1") + F.col("n_2")).cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("base"), blocks.alias("blocks"))
    best = [F.coalesce(F.array_max(F.transform("blocks", _contained_in(t, order, threshold))), F.lit(0.0)) for t in parts.values()]
    rows = rows.select("*", *[b.alias(f"t_{i}") for i, b in enumerate(best)])
    own = F.array_compact(F.array(*[F.when(F.col(f"t_{i}") > 0, F.lit(label)) for i, label in enumerate(sets)]))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.greatest(*[F.col(f"t_{i}") for i in range(len(sets))])).alias("score"),
    )
