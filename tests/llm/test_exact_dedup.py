import hashlib
import re

import pytest
from comparing import assert_same

from tracewell.llm import exact_dedup, queries
from tracewell.llm.oracles import ORACLES


def test_whole_table_against_sql(spark, sf_dir):
    assert_same(queries.op8_exact_dedup(spark, sf_dir), ORACLES["op8_exact_dedup"], sf_dir)


@pytest.mark.parametrize("heavy", [4, 256])
def test_hot_groups(spark, documents, heavy):
    rows = [(i, "hot\ttext" if i % 3 == 0 else f"other {i % 40}", "s") for i in range(900)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(documents(rows), heavy).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    for text, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[1:] == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())


def test_summary_names_every_heavy_digest(spark, documents):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise(F.col("id").cast("string")).alias("text_sha256"), F.col("id").alias("rid")).withColumn("digest_key", F.xxhash64("text_sha256")).repartition(40)
    assert {(r["text_sha256"], r["n"]) for r in exact_dedup.heavy_digests(rows, 16).collect()} == {("a", 1000), ("b", 572)}


def test_odd_rows(spark, documents, odd_rows):
    got = exact_dedup.exact_dedup(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert len(by) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in odd_rows})
    for rows in by.values():
        assert sum(r["kept"] for r in rows) == 1 and {r["group_size"] for r in rows} == {len(rows)}
    assert exact_dedup.exact_dedup(documents([])).count() == 0
