import random
import re

import numpy as np
import pytest
from comparing import assert_same

from tracewell.llm import near_dedup, queries
from tracewell.llm.components import components
from tracewell.llm.oracles import ORACLES


def sets(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    found, parent = {i: sets(t) for i, t in docs.items()}, {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(found[a] & found[b])
            if shared and 100 * shared >= 75 * len(found[a] | found[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(found[i]), root(i), root(i) == i) for i in docs}


def test_whole_table_against_sql(spark, sf_dir):
    assert_same(queries.op10_minhash_near_dedup(spark, sf_dir), ORACLES["op10_minhash_near_dedup"], sf_dir)


def test_groups_of_near_copies_against_brute_force(spark, documents):
    """Copies at many distances from their source, so that links are a few of the pairs."""
    draw, docs = random.Random(9), {}
    for g in range(4):
        source = [f"w{draw.randrange(5000)}" for _ in range(120)]
        for i in range(60):
            words = list(source)
            for _ in range(draw.randrange(9)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(9999)}"
            docs[1000 - g * 100 - i] = " ".join(words)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_dedup(documents([(i, t, "s") for i, t in docs.items()])).collect()}
    assert got == brute(docs)


def test_estimates_and_bounds():
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 2**63, 1500, dtype=np.uint64)
    for shared in (100, 600, 900):
        a, b = pool[: 500 + shared // 2], pool[500 - shared // 2 : 1000]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.mean(near_dedup.minima(a) == near_dedup.minima(b))
        assert same == pytest.approx(true, abs=0.2)
        x = near_dedup.bitmap(a).view(np.uint64) ^ near_dedup.bitmap(b).view(np.uint64)
        assert sum(bin(int(v)).count("1") for v in x) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components_of_chains_stars_and_cycles(spark, local):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 203)}
    assert components(spark.createDataFrame([], "a long, b long"), local).count() == 0


def test_long_chain(spark):
    chain = spark.range(100_000).selectExpr("id as a", "id + 1 as b")
    assert components(chain, 0).agg({"component": "max", "id": "count"}).first().asDict() == {"max(component)": 0, "count(id)": 100_001}


def test_repeated_rows_are_one_document(spark, documents, monkeypatch):
    words = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(words), "s")] * 5000 + [(2, " ".join([*words[:40], "x", *words[41:]]), "s")] * 5000
    seen, verify = [], near_dedup.verify
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, texts, percent: (seen.append((pairs.count(), texts.count())), verify(pairs, texts, percent))[1])
    got = near_dedup.near_dedup(documents(rows)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, True, 5000), (2, 1, False, 5000)}
    assert [p for p, _ in seen if p] == [1] and {t for _, t in seen} == {2}


def test_odd_rows(spark, documents, odd_rows):
    rows = [*odd_rows, (40, "Tie", "a"), (41, "one two three four", "a"), (42, "ONE two\nthree\tfour", "a"), (43, "one two three", "a")]
    df = documents(rows)
    got = near_dedup.near_dedup(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[5] == (0, 5, True)
    assert by[2][1] == 1 and by[8] == (1, 7, False) and by[40] == (1, 7, False) and by[42] == (1, 41, False) and by[43][1] == 43
    assert sum(r["doc_id"] is None and r["kept"] for r in got) == 2
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r["doc_id"] or 0 for r in got if r["kept"])
    assert near_dedup.near_dedup(documents([])).count() == 0
