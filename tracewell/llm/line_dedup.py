"""Line dedup: repeated runs of lines are found in a suffix array and their later copies deleted.

Lines that occur once in the corpus can be in no repeated run, so a document reduces to stretches of
consecutive repeated lines, as arrays of line ids. Distributed prefix doubling (eightfold a round)
ranks all suffixes of the stretches: a round sorts the distinct tuples of eight ranks by range, and the place
in that order is the next rank. Suffixes that share their first lines with at least `min_words` words form an
interval of the array's longest common prefixes. Of these, only intervals that cannot be extended to the
left are followed up, since the others lie inside their runs; in each, equal suffixes are one class,
and neighbouring classes are compared line by line for their common prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import NOT_SPACE, maybe_among, settle

MIN_WORDS, FOLD = 50, 8
_PAD = -1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEY = ["doc_id", "dh", "start"]


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("dh"), F.posexplode(F.split("text", "\n")).alias("j", "line"))
    return rows.select("doc_id", "dh", "j", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(3), "line").alias("h2"), F.regexp_count("line", F.lit(NOT_SPACE)).alias("w"))


def stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """Runs of consecutive lines that each occur at least twice: doc_id, dh, start, ids, w."""
    lines = _lines(docs)
    repeated = settle(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2", F.monotonically_increasing_id().alias("id")))
    rows = lines.join(repeated, ["h1", "h2"]).groupBy("doc_id", "dh").agg(F.array_sort(F.collect_set(F.struct("j", "id", "w"))).alias("lines"))  # a set, because repeated rows are one document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, dh, lines in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                for i in range(1, len(lines) + 1):
                    if i == len(lines) or lines[i]["j"] > lines[i - 1]["j"] + 1:
                        run = lines[at:i]
                        if sum(x["w"] for x in run) >= min_words:
                            for column, value in zip(out, (doc_id, dh, run[0]["j"], [x["id"] for x in run], [x["w"] for x in run])):
                                column.append(value)
                        at = i
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "dh", "start", "ids", "w"])

    return settle(rows.mapInArrow(cut, "doc_id long, dh long, start int, ids array<long>, w array<int>"))


def suffix_ranks(runs: DataFrame) -> DataFrame:
    """Add `ranks`: the place of each suffix of `ids` among all, equal suffixes sharing one."""
    longest = runs.agg(F.max(F.size("ids"))).first()[0] or 0
    now, length, classes = runs.withColumn("ranks", F.col("ids")), 1, -1
    keys = [f"k{i}" for i in range(FOLD)]
    while length < longest or classes < 0:
        flat = now.select(*_KEY, F.explode(_tuples(length)).alias("t")).select(*_KEY, "t.*")
        order = settle(flat.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()))
        back = flat.join(order, keys).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("p", "rank", "id", "w"))).alias("s"))
        now = settle(back.select(*_KEY, F.col("s.id").alias("ids"), F.col("s.w").alias("w"), F.col("s.rank").alias("ranks")))
        length, before, classes = length * FOLD, classes, order.count()
        if classes == before:  # no class was split, so none will be
            break
    return now


def _tuples(length: int):
    def at(p):
        ahead = [F.coalesce(F.get(F.col("ranks"), p + i * length), F.lit(_PAD)).cast("long").alias(f"k{i}") for i in range(FOLD)]
        return F.struct(p.alias("p"), F.get(F.col("ids"), p).alias("id"), F.get(F.col("w"), p).alias("w"), *ahead)

    return F.transform(F.sequence(F.lit(0), F.size("ranks") - 1), at)


def _seeds(min_words: int):
    """Suffixes with min_words words: the key of their first lines to hold as many, and the line before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = [np.uint64(pow(b, -1, 1 << 64)) for b in _BASES]
        for batch in batches:
            out = []
            for doc_id, dh, start, ids, w, ranks in zip(*(c.to_pylist() for c in batch.columns)):
                x, n = np.array(ids, np.uint64) + np.uint64(1), len(ids)
                words = np.concatenate([[0], np.cumsum(w)])
                end = np.searchsorted(words, words[:-1] + min_words)  # the first end with enough words
                p = np.flatnonzero(end <= n)
                sums = []
                for b, inv in zip(_BASES, inverse):
                    power, back, total = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
                    power[1:], back[1:] = np.cumprod(np.full(n, b, np.uint64)), np.cumprod(np.full(n, inv, np.uint64))
                    total[1:] = np.cumsum((x * (x ^ np.uint64(b >> 7))) * power[:n])
                    sums.append(((total[end[p]] - total[p]) * back[p]).view(np.int64))
                before = np.where(p > 0, np.array(ids, np.int64)[p - 1], -1)
                out.append((np.full(len(p), doc_id), np.full(len(p), dh), np.full(len(p), start), p, np.array(ranks, np.int64)[p], n - p, sums[0], sums[1], end[p] - p, before))
            names = ["doc_id", "dh", "start", "p", "rank", "rest", "a1", "a2", "a3", "before"]
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    return run


def _longest_earlier(df: pd.DataFrame) -> pd.DataFrame:
    """For the suffix classes of one interval: the longest prefix shared with a class that occurs earlier."""
    df = df.sort_values("rank").reset_index(drop=True)
    tails = [np.asarray(x) for x in df["tail"]]
    at = list(zip(df["doc_id"], df["dh"], df["line"]))
    common = [0]
    for x, y in zip(tails, tails[1:]):
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        common.append(int(differ[0]) if len(differ) else n)
    best = [0] * len(df)
    for order in (range(len(df)), range(len(df) - 1, -1, -1)):
        stack: list[list] = []  # earlier classes and what each shares with the suffix at hand
        last = None
        for i in order:
            step = common[i] if order.step > 0 else (common[last] if last is not None else 0)
            reach = step
            while stack and at[stack[-1][0]] > at[i]:
                reach = min(reach, stack.pop()[1])
            if stack:
                best[i] = max(best[i], reach)
            stack.append([i, reach])
            last = i
    df["length"] = best
    return df.loc[df["length"] > 0, ["doc_id", "dh", "line", "length"]]


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Ranges of lines to delete: doc_id, dh (hash of the text), line, length."""
    runs = suffix_ranks(stretches(docs, min_words))
    names = ["doc_id", "dh", "start", "p", "rank", "rest", "a1", "a2", "a3", "before"]
    seeds = settle(runs.select(*_KEY, "ids", "w", "ranks").mapInArrow(_seeds(min_words), ", ".join(f"{n} long" for n in names)))
    interval = ["a1", "a2", "a3"]
    groups = seeds.groupBy(*interval).agg(F.count("*").alias("n"), F.min("before").alias("low"), F.max("before").alias("high"))
    # Stored, so that a join with it has nothing but exchanges below, and Spark can split a passage that is everywhere.
    groups = settle(groups.where("n > 1 and (low < high or low = -1)").select(*interval))
    kept = settle(seeds.join(groups, interval).withColumn("line", F.col("start") + F.col("p")))
    firsts = settle(kept.groupBy(*interval, "rank").agg(F.min(F.struct("doc_id", "dh", "line", "start", "p")).alias("first")))
    same = kept.join(firsts, [*interval, "rank"]).where(F.struct("doc_id", "dh", "line") != F.struct("first.doc_id", "first.dh", "first.line"))
    same = same.select("doc_id", "dh", "line", F.col("rest").alias("length"))
    several = firsts.groupBy(*interval).agg(F.count("*").alias("n")).where("n > 1").select(*interval)
    wanted = firsts.join(several, interval).select(*interval, "rank", "first.*")
    tails = wanted.join(runs.select(*[F.col(c).cast("long").alias(c) for c in _KEY], "ids"), _KEY).select(*interval, "rank", "doc_id", "dh", "line", F.expr("slice(ids, cast(p as int) + 1, size(ids))").alias("tail"))
    partial = tails.groupBy(*interval).applyInPandas(_longest_earlier, "doc_id long, dh long, line long, length long")
    return settle(same.unionByName(partial))


def _others(docs: DataFrame):
    """All columns but text in one, where no name can clash with those made here."""
    return F.struct(*[c for c in docs.columns if c != "text"]).alias("row")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` (doc_id, text and any others) with later copies of repeated line runs deleted from text.

    Lines are what "\\n" separates. Line i of a document is deleted if it lies in a run of
    consecutive lines, of at least `min_words` words, that also stands earlier in the corpus: in a document of smaller doc_id,
    or further up in the same one. Adds n_lines and removed_lines (in place of columns so named). Null texts and rows of null doc_id
    are left as they are, a document of which nothing remains gets an empty text. Rows that repeat a
    doc_id and text are one document and are treated alike; those that share a doc_id alone are in the order of a hash of
    their texts.
    """
    gone = deletions(docs, min_words).groupBy(F.col("doc_id").alias("id"), "dh").agg(F.collect_set(F.struct("line", "length")).alias("gone"))
    rows = docs.select(_others(docs), "doc_id", "text", F.xxhash64("text").alias("mine"))
    marked = maybe_among(rows, "doc_id", gone.select("id"))
    hit = marked.where("maybe").join(gone, (F.col("doc_id") == F.col("id")) & (F.col("mine") == F.col("dh")), "left").withColumn("lines", F.split("text", "\n"))
    stays = F.filter("lines", lambda x, i: ~F.exists("gone", lambda g: (i >= g["line"]) & (i < g["line"] + g["length"])))
    hit = hit.withColumn("left", F.when(F.col("gone").isNotNull(), stays).otherwise(F.col("lines")))

    def result(df: DataFrame, text, n_lines, removed) -> DataFrame:
        own = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "removed_lines")]
        return df.select(*own, F.coalesce(n_lines, F.lit(0)).alias("n_lines"), F.coalesce(removed, F.lit(0)).alias("removed_lines"))

    clear = result(marked.where("not maybe"), F.col("text"), F.size(F.split("text", "\n")), F.lit(0))
    return clear.unionByName(result(hit, F.array_join("left", "\n"), F.size("lines"), F.size("lines") - F.size("left")))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with line_dedup()'s texts (and n_chars, if there is one); documents of which nothing remains go."""
    packed = docs.select("doc_id", "text", _others(docs))
    done = line_dedup(packed, min_words).where("removed_lines = 0 or removed_lines < n_lines")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("removed_lines") > 0, F.char_length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
