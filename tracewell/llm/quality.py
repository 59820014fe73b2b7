"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features and those of both neighbours score the two states, and
a 2 x 2 table scores what follows what; forward-backward gives each line's marginal probability of
being good. Their mean, weighted by line length, is the document's quality, on a scale that is
calibrated to the labels. Lines have no labels of their own, so in training each takes its document's, and those
that clearly are of the other kind change sides for a second fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import released, settle

#: Labelled documents that the fit uses at most, those of the smallest hashes, and the lines that they may have together: 264 bytes each on the driver.
SAMPLE_DOCS, SAMPLE_LINES = 6000, 400_000
#: Lines of a training sequence; longer documents give several.
SEGMENT = 24
#: While all lines of a document have its label, states never change, and only EDGE_LIMIT keeps the edges finite.
STEPS, RELABELED_STEPS, RATE, RIDGE, EDGE_LIMIT = 200, 60, 0.05, 1e-3, 1.5
#: Marginal probability from which a line's state is believed against its document's label.
SURE = 0.97
THRESHOLD = 0.3

_KEEP = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t", "stop": b".,;:'\"-",
    "mark": b"#$%&*+=<>{}[]\\^~_@", "bar": b"|/", "shout": b"!?", "beyond": bytes(range(128, 256)),
}
_DROP = {k: bytes(set(range(256)) - set(v)) for k, v in _KEEP.items()}
FEATURES = 22


def _line(line: str, seen: set[int]) -> list[float]:
    raw = line.encode()
    n = max(1, len(raw))
    shares = [len(raw.translate(None, drop)) / n for drop in _DROP.values()]
    words = raw.split()
    k = max(1, len(words))
    runs = sum(a == b for a, b in zip(words, words[1:]))
    again = hash(line) in seen
    seen.add(hash(line))
    caps = sum(w.isupper() for w in words) / k
    marked = sum(w[-1:] in b"#$%&*!|" for w in words) / k
    return [
        *shares, math.log1p(len(raw)), math.log1p(len(words)), len(raw) / k / 10, len(set(words)) / k, runs / k, float(again and len(raw) > 0),
        caps, marked, float(not words), float(raw[:1].isupper()), float(raw[-1:] in b".!?"), max(map(len, words), default=0) / 20, float(len(set(words)) * 2 <= len(words)),
    ]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x 3 FEATURES: own, previous, next) and line lengths of a whole text; null is empty, which is one empty line."""
    lines, seen = (text or "").split("\n"), set()
    own = np.array([_line(x, seen) for x in lines])
    edge = np.zeros((1, own.shape[1]))
    return np.concatenate([own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])], axis=1), np.array([len(x) + 1.0 for x in lines])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    edges: np.ndarray  # log potentials [from, to]
    slope: float = 1.0
    shift: float = 0.0

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """Log potential of good over bad for each line."""
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(quality) + self.shift, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


def marginals(node: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Probability that each line is good, by forward-backward on likelihood ratios good : bad."""
    (bb, bg), (gb, gg) = np.exp(edges).tolist()
    potentials = np.exp(np.clip(node, -50, 50)).tolist()
    n = len(potentials)
    ahead, r = [0.0] * n, 1.0
    for i, p in enumerate(potentials):
        r = p * ((bg + r * gg) / (bb + r * gb) if i else 1.0)
        ahead[i] = r = min(max(r, 1e-100), 1e100)
    back, r, out = 1.0, 1.0, np.empty(n)
    for i in range(n - 1, -1, -1):
        if i < n - 1:
            r = potentials[i + 1] * back
            back = min(max((gb + r * gg) / (bb + r * bg), 1e-100), 1e100)
        odds = min(max(ahead[i] * back, 1e-100), 1e100)
        out[i] = odds / (1 + odds)
    return out


def likelihood(theta: np.ndarray, x: np.ndarray, here: np.ndarray, good: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the states `good` (lines x sequences, as `here`, which marks the lines there are), weighted by `each`
    sequence; its gradient; and the marginals of all lines."""
    (width, count), weights, bias, edges = here.shape, theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
    node = (x @ weights.astype(x.dtype) + bias) * here
    a, b = np.zeros((width, count, 2)), np.zeros((width, count, 2))
    a[0, :, 1] = node[0]
    for t in range(1, width):
        into = np.logaddexp(a[t - 1][:, 0:1] + edges[0], a[t - 1][:, 1:2] + edges[1])
        into[:, 1] += node[t]
        a[t] = np.where(here[t][:, None] > 0, into, a[t - 1])
    total = np.logaddexp(a[-1, :, 0], a[-1, :, 1])
    for t in range(width - 2, -1, -1):
        ahead = b[t + 1] + np.stack([np.zeros(count), node[t + 1]], axis=1)
        back = np.logaddexp(ahead[:, 0:1] + edges[:, 0], ahead[:, 1:2] + edges[:, 1])
        b[t] = np.where(here[t + 1][:, None] > 0, back, 0.0)
    p = np.exp(np.clip(a[:, :, 1] + b[:, :, 1] - total, -60, 0)) * here
    score, miss = (node * good).sum(axis=0), (p - good * here) * each
    grad = np.zeros_like(theta)
    grad[:-5] = np.tensordot(miss.astype(x.dtype), x, axes=2)
    grad[-5] = miss.sum()
    for i in range(2):
        for j in range(2):
            pair = a[:-1, :, i] + edges[i, j] + (node[1:] if j else 0) + b[1:, :, j] - total
            both = np.exp(np.clip(pair, -60, 0)) * here[1:]
            seen = ((good[:-1] == i) & (good[1:] == j)) * here[1:]
            score = score + edges[i, j] * seen.sum(axis=0)
            grad[-4 + 2 * i + j] = ((both - seen) * each).sum()
    return float(((total - score) * each).sum()), grad, p


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Fit to (features, lengths, label) of documents: maximum likelihood of the line sequences by Adam, then the calibration.

    Lines take their document's label at first; then those that the model is SURE are of the other kind change
    sides, and the fit goes on with sequences in which states do change.
    """
    if not docs:
        zero = np.zeros(3 * FEATURES)
        return Model(zero, zero + 1, zero, 0.0, np.zeros((2, 2)))
    stacked = np.concatenate([x for x, _, _ in docs])
    mean, scale = stacked.mean(axis=0, dtype=np.float64), stacked.std(axis=0, dtype=np.float64) + 1e-6
    del stacked
    pieces = [(x[i : i + SEGMENT], y) for x, _, y in docs for i in range(0, len(x), SEGMENT)]
    count, width = len(pieces), max(len(x) for x, _ in pieces)
    x = np.zeros((width, count, 3 * FEATURES), np.float32)
    here = np.zeros((width, count))
    for j, (p, _) in enumerate(pieces):
        x[: len(p), j] = np.clip((p - mean) / scale, -6, 6)
        here[: len(p), j] = 1
    label = np.array([y for _, y in pieces], float) * here
    # Documents weigh alike, however many sequences they give.
    each = np.concatenate([np.full(-(-len(f) // SEGMENT), 1 / len(f)) for f, _, _ in docs])
    each *= len(docs) / (each[None, :] * here).sum()
    theta, p = np.zeros(3 * FEATURES + 5), np.zeros_like(here)
    for steps, edge_limit in ((STEPS, EDGE_LIMIT), (RELABELED_STEPS, np.inf)):
        # No line changes sides before the first fit, when p is 0 everywhere and label is all there is.
        good = np.where(p > SURE, 1.0, np.where(p < 1 - SURE, 0.0, label)) * here if p.any() else label
        m = v = 0.0
        for step in range(1, steps + 1):
            _, grad, p = likelihood(theta, x, here, good, each)
            grad = grad / len(docs) + RIDGE * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            theta[-4:] = np.clip(theta[-4:], -edge_limit, edge_limit)
    model = Model(mean, scale, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))
    q = _logit(np.array([quality_of(model, f, n) for f, n, _ in docs]))
    y = np.array([y for _, _, y in docs], float)
    c = np.zeros(2)
    design = np.stack([q, np.ones_like(q)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ c, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        c -= np.clip(np.linalg.solve(hessian, design.T @ (p - y) + 1e-3 * c), -2, 2)
    model.slope, model.shift = max(float(c[0]), 1e-3), float(c[1])
    return model


def quality_of(model: Model, features: np.ndarray, lengths: np.ndarray) -> float:
    return float(marginals(model.nodes(features), model.edges) @ lengths / lengths.sum())


def training_docs(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Labelled documents outside the held-out fifth, whole, as features of all their lines: at most `sample`, and in the order of their hashes as many as have `lines` lines together.

    A document that is longer than that by itself is passed over. A doc_id that repeats is one document, with the text of the smallest hash and the lower of its labels.
    """
    mine = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("quality").isin(0, 1))
    mine = mine.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = settle(rows)  # `sample` rows at most
    sizes = rows.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n")).where(F.col("n") <= lines)
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(F.broadcast(sizes.withColumn("upto", upto).where(F.col("upto") <= lines).select("doc_id")), "doc_id")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            both = [line_features(t) for t in df["text"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "quality": df["quality"], "x": [f.astype("<f4").tobytes() for f, _ in both], "n": [n.astype("<f8").tobytes() for _, n in both]})

    # As bytes, because rows of numbers would take the driver ten times the memory.
    rows = rows.mapInPandas(featured, "doc_id long, quality int, x binary, n binary")
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["quality"], bytes(r["n"]), bytes(r["x"])))
    return [(np.frombuffer(r["x"], "<f4").reshape(len(r["n"]) // 8, -1), np.frombuffer(r["n"], "<f8"), r["quality"]) for r in found]


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> DataFrame:
    """Quality of every row of `docs` (doc_id, text; others are ignored).

    Returns doc_id, held_out, score, predicted (1 if score >= 0.3), bad_lines. Null and empty texts
    are one empty line and get its score; a null doc_id is not held out; repeated rows score alike. Without
    labels every document scores 0.5. `sample` and `lines` bound what the fit reads (training_docs).
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training_docs(docs, labels, sample, lines)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            quality, bad = [], []
            for text in batch.column(1):
                x, n = line_features(text.as_py())
                p = marginals(m.nodes(x), m.edges)
                quality.append(float(p @ n / n.sum()))
                bad.append(int((p < 0.5).sum()))
            scores = m.score(np.array(quality))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(bad, pa.int64())], ["doc_id", "score", "predicted", "bad_lines"])

    rows = docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double, predicted int, bad_lines long")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted", "bad_lines")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> DataFrame:
    """The rows of docs, all columns, that classify() predicts to be good."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_docs(docs, labels, sample, lines)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            quality = np.array([quality_of(m, *line_features(t.as_py())) for t in batch.column(at)])
            yield batch.filter(pa.array(m.score(quality) >= THRESHOLD))

    return docs.mapInArrow(released(run), docs.schema)
