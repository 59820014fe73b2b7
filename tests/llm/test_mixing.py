import math
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm.mixing import WEIGHTS, mix, repeat
from tracewell.llm.queries import op5_source_mixing


def want_targets(sizes):
    """The resharing loop as the contract words it."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def hold(rows, docs):
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, taken, largest = want_targets(sizes), {}, {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    return {s: (taken[s], want[s], largest[s]) for s in sizes}


def test_whole_table_meets_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for taken, want, largest in hold(mix(docs).collect(), docs.collect()).values():
        assert abs(taken - want) <= max(0.02 * want, min(largest, 0.5 * want))
    a, b = (sorted(map(tuple, op5_source_mixing(spark, sf_dir).collect())) for _ in range(2))
    assert a == b


def test_targets_stop_at_three_sizes(spark, documents):
    rows = [(i, "w " * (i % 50 + 1), "big") for i in range(400)] + [(1000 + i, "w w w", "tiny") for i in range(4)] + [(2000 + i, "w " * 9, None) for i in range(30)]
    got = mix(documents(rows)).collect()
    found = hold(got, documents(rows).collect())
    assert found["tiny"][0] == found["tiny"][1] == 36
    for taken, want, _ in found.values():
        assert abs(taken - want) <= 0.02 * want + 9


def test_repeat_gives_what_mix_says(spark, documents):
    df = documents([(i, "w " * (1 + i * 7 % 40), "ab"[i % 3 == 0]) for i in range(300)])
    want = {r["doc_id"]: r["copies"] for r in mix(df).collect() if r["copies"]}
    got = repeat(df)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == want


def test_odd_rows(spark, documents, odd_rows):
    got = mix(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(math.isfinite(r["target"]) for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    assert mix(documents([])).count() == 0 and repeat(documents([])).count() == 0
    blank = mix(documents([(1, None, "a"), (2, "", "b")])).select(F.sum("taken")).first()[0]
    assert blank == 0
