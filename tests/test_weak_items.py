"""Settings files, sketches, strict groups and endings on odd input."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewell.functions import text, vectors
from tracewell.operators import sketches
from tracewell.sources import records


def test_settings_of_every_kind(spark, tmp_path):
    (tmp_path / "a.b.yaml").write_text("top: 1\r\n# note\n\none:\n  int: -3\n  float: 2.5e-4 # why\n  whole: \"x: # y\"\n  none: ~\ntwo:\n    flag: TRUE\n    url: http://x/y:8\n    ver: 1.2.3\nlast: ''\n")
    (tmp_path / "empty.yaml").write_text("")
    got = {(r["file"], r["section"], r["key"]): (r["value"], r["kind"]) for r in records.settings(spark, str(tmp_path)).collect()}
    want = {
        ("", "top"): ("1", "int"), ("one", "int"): ("-3", "int"), ("one", "float"): ("2.5e-4", "float"), ("one", "none"): (None, "null"),
        ("two", "flag"): ("true", "bool"), ("two", "url"): ("http://x/y:8", "str"), ("two", "ver"): ("1.2.3", "str"), ("", "last"): ("", "str"), ("one", "whole"): ("x: # y", "str"),
    }
    assert got == {("a.b", *k): v for k, v in want.items()}


def test_merged_sketches_keep_their_error_bounds(spark):
    """A hundred parts of 200,000 rows, half of whose ids repeat: count within 4 deviations, quantiles within 4 % of the ranks."""
    n = 200_000
    rows = spark.range(n).select((F.col("id") % 100).alias("part"), F.lit("k").alias("k"), (F.col("id") % (n // 2)).alias("ident"), F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).otherwise(float("nan")).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(3, "none", None, None)], "part long, k string, ident long, x double"))
    got = {r["k"]: r for r in sketches.estimates(sketches.merged(sketches.sketched(rows, ["part", "k"], "ident", "x"), ["k"]), ["k"], {"low": 0.1, "high": 0.9}).collect()}
    assert got["k"]["n"] == n and got["k"]["n_distinct"] == pytest.approx(n / 2, rel=4 * 1.04 / 64)
    assert got["k"]["low"] == pytest.approx(0.1 * n, abs=0.04 * n) and got["k"]["high"] == pytest.approx(0.9 * n, abs=0.04 * n)
    assert tuple(got["none"]) == ("none", 1, 0, None, None)
    assert sketches.merged(sketches.sketched(rows.where("false"), ["k"], "ident", "x"), ["k"]).count() == 0


def test_strict_groups(spark):
    rows = spark.createDataFrame([([0.5, -1.0, 0.25, 2.0],), (None,)], "w array<double>")
    same = rows.select(vectors.quantize_strictly(F.col("w"), 4, 2).alias("a"), vectors.quantize(F.col("w"), 4, 2).alias("b")).collect()
    assert same[0]["a"] == same[0]["b"] and same[1]["a"] is None
    with pytest.raises(PySparkException, match="groups of 3 do not divide a row of 4"):
        rows.select(vectors.quantize_strictly(F.col("w"), 4, 3)).collect()


def test_endings(spark):
    rows = spark.createDataFrame([("a.weight_scale",), ("a.weight",), (None,), ("a.weight_scales",)], "n string")
    assert [r[0] for r in rows.select(text.ends_with_any(F.col("n"), text.QUANT_SUFFIXES)).collect()] == [True, False, False, False]
