import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import temporal


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(4)
    row = lambda i: (draw.choice(["a", "b", None]), draw.choice([None, *range(30)]), i)
    return [row(i) for i in range(80)], [row(i) for i in range(100, 160)]


def test_as_of(spark, tables):
    left, right = tables
    schema = "k string, at long, id long"
    got = temporal.as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumn("v", F.col("id") * 2), ["k"], "at", "id", ["v"])
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {}
    for row in left:
        before = [r for r in right if r[0] == row[0] and order(r) <= order(row)]
        want[row[2]] = 2 * max(before, key=order)[2] if before else None
    assert {r["id"]: r["last_v"] for r in got.collect()} == want and any(v is not None for v in want.values())
    assert got.where("false").count() == 0


def test_in_intervals(spark, tables):
    left, right = tables
    spans = [(k, at, i, at + i % 17) for k, at, i in right if at is not None] + [("a", None, 1, 5), ("a", 9, 2, 9), ("b", -3, 3, 40)]
    points = spark.createDataFrame(left, "k string, at long, p long")
    intervals = spark.createDataFrame(spans, "k string, start long, i long, stop long")
    got = temporal.in_intervals(points, intervals, ["k"], F.col("at"), F.col("start"), F.col("stop"), 5.0)
    want = sorted((p, i) for k, at, p in left for j, start, i, stop in spans if k is not None and k == j and at is not None and start is not None and start <= at < stop)
    assert sorted((r["p"], r["i"]) for r in got.collect()) == want and want


def test_levels_tell_a_null_from_a_sum(spark):
    rows = spark.createDataFrame([("x", None), ("x", 1), (None, 1)], "a string, b int")
    got = {(r["a"], r["b"], r["level"]): r["n"] for r in temporal.levels(rows, ["a", "b"], F.count("*").alias("n")).collect()}
    assert got[(None, None, 3)] == 3 and got[("x", None, 1)] == 2 and got[("x", None, 0)] == 1 and got[(None, 1, 2)] == 2 and got[(None, None, 1)] == 1
