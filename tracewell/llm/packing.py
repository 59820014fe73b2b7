"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A bin is filled greedily with the largest pieces that fit; then its smallest piece gives way to
two unpacked pieces if those fill the expanded gap more tightly. Only lengths matter to this, and
there are at most `limit` of them, so the plan is made once on the histogram of lengths: each step
fixes the contents of a bin and how often they can be repeated before a length runs out. The plan
therefore has at most a few thousand entries however large the corpus, and the pieces are dealt to
its places by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import released, settle

#: Tokens and chunks whose ids a worker remembers: about 100 MB.
CACHED = 500_000
#: What the vocabulary's splitter takes as one token, for the characters of _PLAIN in lower case.
_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[!-/:-@\[-`{-~]+")
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿŒœ]*")
_tokenizers: dict[str, tuple] = {}


def _encoder(path: str):
    """Text to little-endian unsigned 32-bit ids.

    The ids of a text are those of its parts in turn, and each distinct part need be encoded only
    once. Parts are the splitter's tokens where a text has only characters that it treats plainly
    and that normal form C leaves alone; else the chunks between ASCII white space, which it always drops.
    """
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        last = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        last[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        _tokenizers[path] = tokenizer, last, {}
    tokenizer, last, known = _tokenizers[path]

    def learn(words: list[str]) -> None:
        """Encode many tokens as one text: the ids that end a token tell them apart."""
        ids = np.array(tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (4 * (np.flatnonzero(last[ids]) + 1)).tolist()
        if len(ends) != len(words):
            ends = None
        raw, start = ids.tobytes(), 0
        for i, word in enumerate(words):
            if ends is None:
                known[word] = np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                known[word], start = raw[start : ends[i]], ends[i]

    def parts(text: str) -> list:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _TOKENS.findall(text.lower())
        return text.encode().split()

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > CACHED:
            known.clear()
        split = [parts(x or "") for x in texts]
        new = set().union(*split).difference(known)
        words = [x for x in new if isinstance(x, str)]
        for at in range(0, len(words), 500):
            learn(words[at : at + 500])
        for x in new:
            if not isinstance(x, str):
                known[x] = np.array(tokenizer.encode(x.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, x)) for x in split]

    return encode


def tokenize(docs: DataFrame, tokenizer_path: str, limit: int, end_id: int) -> DataFrame:
    """One row per piece of at most `limit` ids, with its rank `nth` among those of its length and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), _encoder(tokenizer_path)
        seen = np.zeros(limit + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                out: list[tuple] = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                        cut = ids[4 * start : 4 * (start + limit)]
                        n = len(cut) // 4
                        out.append((doc_id, piece, start, n, zlib.crc32(cut), part, int(seen[n])))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan_bins(counts: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Best-two-fit over a histogram: [(lengths in a bin, number of such bins)]."""
    left = {n: c for n, c in counts.items() if c > 0}
    alive, plan = sorted(left), []
    while alive:
        used: dict[int, int] = {}

        def largest(room: int) -> int:
            i = bisect_right(alive, room) - 1
            while i >= 0 and used.get(alive[i], 0) >= left[alive[i]]:
                i -= 1
            return alive[i] if i >= 0 else 0

        gap = limit
        while gap and (n := largest(gap)):
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap:
            out = min(used)
            room, best = gap + out, (out, 0, 0)
            i = bisect_right(alive, room - 1)
            while i and best[0] < room:
                i -= 1
                a = alive[i]
                if 2 * a <= best[0]:
                    break
                if used.get(a, 0) >= left[a]:
                    continue
                used[a] = used.get(a, 0) + 1
                b = largest(min(a, room - a))
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
            if best[1]:
                used[out] -= 1
                for n in best[1:]:
                    used[n] = used.get(n, 0) + 1
        used = {n: k for n, k in used.items() if k}
        times = min(left[n] // k for n, k in used.items())
        plan.append(([n for n in sorted(used, reverse=True) for _ in range(used[n])], times))
        for n, k in used.items():
            left[n] -= k * times
        if any(not left[n] for n in used):
            alive = [n for n in alive if left[n]]
    return plan


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack `docs` (doc_id, text; other columns are ignored) into sequences of at most `limit` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    the end id alone. Documents longer than `limit` are cut into whole-length pieces and a rest. Repeated
    rows and null doc_ids are packed like any other row, and an empty table gives no rows.
    """
    pieces = settle(tokenize(docs, tokenizer_path, limit, end_id))
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `limit` rows at most
    entries, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for lengths, times in plan_bins(counts, limit):
        offset = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            entries.append((n, taken[n], k, sequence, offset))
            taken[n] += k * times
            offset += k * n
        sequence += times
    entries.sort()
    places = docs.sparkSession.sparkContext.broadcast(np.array(entries, np.int64).reshape(-1, 5))

    def place(batches: Iterator) -> Iterator:
        n, start, k, seq, offset = places.value.T
        lengths, bounds = np.unique(n, return_index=True)
        ends = np.append(bounds[1:], len(n))
        for df in batches:
            if len(df):
                length, rank = df["length"].to_numpy(), df["rank"].to_numpy()
                at = np.empty(len(df), np.int64)
                for i in np.unique(np.searchsorted(lengths, length)):
                    mine = length == lengths[i]
                    at[mine] = bounds[i] + np.searchsorted(start[bounds[i] : ends[i]], rank[mine], "right") - 1
                nth = rank - start[at]
                df["sequence_id"], df["offset"] = seq[at] + nth // k[at], offset[at] + nth % k[at] * length
            else:
                df["sequence_id"], df["offset"] = df["rank"], df["rank"]
            yield df.drop(columns="rank")

    ranked = pieces.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
