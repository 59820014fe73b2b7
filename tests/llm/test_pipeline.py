import corpus_pipeline
from test_line_dedup import brute as deduped_lines
from test_near_dedup import brute as components

from tracewell.llm import mixing


def test_stages_one_after_another(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stored = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        stored[name] = docs
        assert name == "packing" or docs.columns == columns
    text = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in stored.items() if name != "packing"}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in text["quality"] for i in good) >= 0.95 * len(good)
    assert sum(i in text["quality"] for i, q in labels.items() if q == 0) <= 0.2 * (len(labels) - len(good))
    left = deduped_lines(text["quality"], 50)
    assert text["line_dedup"] == {i: t for i, t in left.items() if t or not text["quality"][i]}
    kept = components(text["line_dedup"])
    assert text["near_dedup"].keys() == {i for i, (_, _, stays) in kept.items() if stays}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stored["near_dedup"]).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in stored["mixing"].groupBy("doc_id").count().collect()} == copies
    packed = stored["packing"].where("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in packed} == copies


def test_run_is_the_stages_in_turn(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_on_odd_rows_and_an_empty_table(spark, sf_dir, tmp_path, documents, odd_rows):
    """Nulls, empty and long texts, ties and repeated rows through the whole chain."""
    docs, ids = documents(odd_rows, extra=False), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(ids["quality"]) == len(odd_rows)  # none is rejected
    assert sorted(ids["line_dedup"], key=str) == sorted(ids["quality"], key=str)
    assert sorted(ids["near_dedup"], key=str) == [1, 3, 4, 5, 6, 6, 7, None, None]
    assert set(ids["mixing"]) <= set(ids["near_dedup"]) == {1, 3, 4, 5, 6, 7, None} and set(ids["packing"]) == set(ids["mixing"])
    empty = documents(odd_rows, extra=False).where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0
