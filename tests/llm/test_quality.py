import itertools
import zlib

import numpy as np
import pytest

from tracewell.llm import quality
from tracewell.llm.queries import op7_quality_classifier


def test_marginals_by_enumeration():
    draw = np.random.default_rng(1)
    for n in (1, 2, 5):
        node, edges = draw.normal(size=n), draw.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(node[i] * s for i, s in enumerate(path)) + sum(edges[a, b] for a, b in zip(path, path[1:])))
            total += w
            good += w * np.array(path)
        assert quality.marginals(node, edges) == pytest.approx(good / total)


def test_marginals_stay_finite_on_long_texts():
    p = quality.marginals(np.concatenate([np.full(5000, 40.0), np.full(5000, -40.0)]), np.array([[1.0, -1.0], [-1.0, 1.0]]))
    assert np.isfinite(p).all() and p[0] > 0.99 and p[-1] < 0.01


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op7_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y, _ in held if y == 1], [s for s, y, _ in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(held) > 40 and auc > 0.95 and np.mean([y == p for _, y, p in held]) > 0.9


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b)


def test_odd_rows(spark, documents, odd_rows):
    df = documents(odd_rows)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    none = quality.classify(df, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    kept = quality.keep_good(df, labels)
    good = sorted((r["doc_id"] or -1) for r in got if r["predicted"])
    assert kept.columns == df.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == good
    assert quality.classify(documents([]), labels).count() == 0


def test_likelihood_by_enumeration():
    """Value and gradient against the sum over all labelings and finite differences, with sequences of unequal length."""
    draw = np.random.default_rng(4)
    width, count = 4, 3
    here = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], float)
    x, good, each = draw.normal(size=(width, count, 2)) * here[:, :, None], draw.integers(0, 2, (width, count)) * here, draw.uniform(0.5, 2, count)

    def brute(theta):
        edges, value = theta[-4:].reshape(2, 2), 0.0
        for j in range(count):
            n = int(here[:, j].sum())
            node = x[:n, j] @ theta[:2] + theta[2]
            score = lambda path, node=node: sum(node[i] * s for i, s in enumerate(path)) + sum(edges[a, b] for a, b in zip(path, path[1:]))
            total = np.log(sum(np.exp(score(path)) for path in itertools.product((0, 1), repeat=n)))
            value += each[j] * (total - score([int(s) for s in good[:n, j]]))
        return value

    theta = draw.normal(size=7)
    value, grad, p = quality.likelihood(theta, x, here, good, each)
    assert value == pytest.approx(brute(theta))
    steps = np.eye(7) * 1e-5
    assert grad == pytest.approx([(brute(theta + s) - brute(theta - s)) / 2e-5 for s in steps], abs=1e-6)
    for j in range(count):
        n = int(here[:, j].sum())
        assert p[:n, j] == pytest.approx(quality.marginals(x[:n, j] @ theta[:2] + theta[2], theta[-4:].reshape(2, 2)))


def test_bad_lines_inside_a_good_document(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.training_docs(docs, labels))
    texts = {y: [r["text"] for r in docs.join(labels.where(f"quality = {y}"), "doc_id").orderBy("doc_id").collect() if r["text"].count("\n") >= 14 * y + 7 * (1 - y)] for y in (0, 1)}
    right = lines = 0
    for good, bad in zip(texts[1][:15], texts[0][:15]):
        a, b = good.split("\n"), bad.split("\n")[:7]  # not the same good lines twice: repetition is a sign of bad ones
        x, n = quality.line_features("\n".join([*a[:7], *b, *a[7:14]]))
        p = quality.marginals(model.nodes(x), model.edges)
        want = np.array([1] * 7 + [0] * 7 + [1] * 7)
        right, lines = right + ((p > 0.5) == want).sum(), lines + len(p)
        assert p[7:14].mean() < min(p[:7].mean(), p[14:].mean())
    assert lines >= 100 and right / lines > 0.8


def test_repeated_labelled_documents_are_one(spark):
    long = "\n".join(f"line {i} of many words" for i in range(5000))
    docs = spark.createDataFrame([(1, "a good text")] * 5000 + [(2, long)] * 50 + [(3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    mine = quality.training_docs(docs, labels)
    ids = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    whole = {1: 1, 2: 5000, 3: 1}  # lines: none of a sampled document is left out
    assert len(mine) == len(ids) and sorted(len(n) for _, n, _ in mine) == sorted(whole[i] for i in ids)
    assert len(quality.training_docs(docs, labels, 1)) == 1
    few = [len(n) for _, n, _ in quality.training_docs(docs, labels, lines=1)]
    assert few == [1] and quality.training_docs(docs, labels, lines=0) == []
