import numpy as np
import pytest
from pyspark.sql import types as T

from tracewell.llm.neighbours import Space, best_buckets, search
from tracewell.llm.queries import op3_nearest_neighbours

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("bucket", T.StringType())])


def exact(vectors, query, k=20):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float64)
    scores = (x * np.array(vectors[query], np.float64)).sum(axis=1)
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != query][:k]
    return [(int(ids[j]), float(scores[j])) for j in order]


def recall(rows, vectors, k=20):
    found = total = 0
    for q in {r["query_id"] for r in rows}:
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        want = exact(vectors, q, k)
        assert len(mine) == len(want)
        for r in mine:
            assert r["score"] == pytest.approx(float(np.dot(np.array(vectors[q], np.float64), np.array(vectors[r["vec_id"]], np.float64))), abs=1e-12)
        found += len({i for i, _ in want} & {r["vec_id"] for r in mine})
        total += len(want)
    return found / total


def test_recall_on_the_whole_table(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rows = op3_nearest_neighbours(spark, sf_dir).collect()
    assert {r["query_id"] for r in rows} == {i for i in vectors if i % 20 == 0}
    assert recall(rows, vectors) >= 0.9


def test_unequal_norms(spark):
    draw = np.random.default_rng(3)
    vectors = {i: (draw.normal(size=16) * draw.uniform(0.2, 3)).astype(np.float32).tolist() for i in range(400)}
    rows = search(spark.createDataFrame([(i, v, "x", "y") for i, v in vectors.items()], SCHEMA)).collect()
    assert recall(rows, vectors) >= 0.9


def test_small_blocks_give_the_same(spark):
    draw = np.random.default_rng(4)
    vectors = [(i, draw.normal(size=8).astype(np.float32).tolist(), None, None) for i in range(300)]
    df = spark.createDataFrame(vectors, SCHEMA)
    assert sorted(map(tuple, search(df).collect())) == sorted(map(tuple, search(df, block=7).collect()))


def test_copies_ties_and_odd_rows(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same) for i in range(60)] + [(100, [0.0, 1.0, 0.0]), (101, None), (120, [0.0, 0.0, 0.0]), (140, [float("nan"), 1.0, 0.0]), (160, [float("inf"), 0.0, 0.0]), (None, same), (180, []), (200, [1.0, 2.0]), (0, same), (220, [None, 1.0, 0.0])]
    got = search(spark.createDataFrame([(i, v, "c", "d") for i, v in rows], SCHEMA)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by.keys() == {0, 20, 40, 100}
    assert by[0] == list(range(1, 21)) and by[20] == list(range(20)) and by[40] == list(range(20))
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_query_is_short(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    for n in (15, 21, 50):
        some = {i: vectors[i] for i in sorted(vectors)[:n]}
        rows = search(spark.createDataFrame([(i, v, "x", "y") for i, v in some.items()], SCHEMA), every=1).collect()
        assert {r["query_id"] for r in rows} == set(some)
        assert recall(rows, some) >= 0.9  # asserts min(20, n - 1) rows a query


def test_outliers_of_a_tight_cluster_are_not_short(spark):
    draw = np.random.default_rng(5)
    centre = draw.normal(size=64)
    vectors = {i: ((centre if i >= 10 else -centre) + 0.05 * draw.normal(size=64)).astype(np.float32).tolist() for i in range(1000)}
    rows = search(spark.createDataFrame([(i, v, "x", "y") for i, v in vectors.items()], SCHEMA), every=1).where("query_id < 10").collect()
    assert {r["query_id"] for r in rows} == set(range(10))
    assert recall(rows, vectors) >= 0.9


@pytest.mark.parametrize("scale", [1.5, 3, 100, None])
def test_few_long_vectors_cost_no_recall(spark, scale):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.exp(draw.normal(size=1000))[:, None] if scale is None else np.where(np.arange(1000) == 7, scale, 1)[:, None]
    vectors = {i: v for i, v in enumerate(x.astype(np.float32).tolist())}
    rows = search(spark.createDataFrame([(i, v, "x", "y") for i, v in vectors.items()], SCHEMA)).collect()
    assert {r["query_id"] for r in rows} == set(range(0, 1000, 20))
    assert recall(rows, vectors) >= 0.9


@pytest.mark.parametrize("n", [1, 5, 22, 25, 40])
def test_small_tables_are_exact(spark, n):
    draw = np.random.default_rng(n)
    vectors = {i: draw.normal(size=64).astype(np.float32).tolist() for i in range(n)}
    rows = search(spark.createDataFrame([(i, v, "x", "y") for i, v in vectors.items()], SCHEMA)).collect()
    assert {r["query_id"] for r in rows} == ({i for i in vectors if i % 20 == 0} if n > 1 else set())
    assert not rows or recall(rows, vectors) == 1


def test_each_dimension_is_searched(spark):
    draw = np.random.default_rng(8)
    vectors = {i: draw.normal(size=(64, 64, 7, 3)[i % 4]).astype(np.float32).tolist() for i in range(0, 1300)}
    rows = search(spark.createDataFrame([(i, v, "x", "y") for i, v in vectors.items()], SCHEMA), every=3).collect()
    assert {r["query_id"] for r in rows} == {i for i in vectors if i % 3 == 0}
    for dims in (64, 7, 3):
        some = {i: v for i, v in vectors.items() if len(v) == dims}
        assert recall([r for r in rows if r["query_id"] in some], some) >= 0.9


def test_best_buckets_are_the_best_sums():
    draw = np.random.default_rng(9)
    scores = [draw.normal(size=(5, 8)) for _ in range(3)]
    code, value = best_buckets(scores, 40)
    for i in range(5):
        sums = (scores[0][i][:, None, None] + scores[1][i][None, :, None] + scores[2][i][None, None, :]).ravel()
        assert value[i].tolist() == pytest.approx(sorted(sums, reverse=True)[:40])
        assert sums[code[i]].tolist() == pytest.approx(value[i].tolist())


def test_hash_length_grows_with_the_table():
    lengths = [Space(0, n, 1.0, 64).tuned(cosine).length for n, cosine in ((100, 0.3), (2000, 0.29), (50_000, 0.42), (2_000_000, 0.7), (10**9, 0.8))]
    assert lengths == sorted(lengths) and lengths[0] == 1 and lengths[-1] == 4
