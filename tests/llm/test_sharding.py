import zlib

import numpy as np
import pytest

from tracewell.llm.queries import op9_hilbert_sharding
from tracewell.llm.sharding import hilbert_index, shard, write_shards


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    order = np.argsort(hilbert_index(cells, bits))
    assert sorted(hilbert_index(cells, bits)) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def held(rows, texts, shards, together=False):
    """The law of equal bytes, slots without gaps, shards as runs of the curve; with `together`, texts in one shard that take at most half of one."""
    sizes, slots, curves, counts = np.zeros(shards, int), {}, {}, 0
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode() if r["doc_id"] in texts else None
        if text is not None:
            assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        curves.setdefault(r["shard"], []).append(r["curve"])
        counts += 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    runs = [(min(c), max(c)) for _, c in sorted(curves.items())]
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:]))
    largest = max((r["size"] for r in rows), default=0)
    if together:
        copies = {}
        for r in rows:
            copies.setdefault((r["size"], r["text_crc32"]), []).append(r["shard"])
        whole = {k: c for k, c in copies.items() if k[0] * len(c) * 2 * shards <= sizes.sum()}
        assert all(len(set(c)) == 1 for c in whole.values())
        largest = max([largest, *(k[0] * len(c) for k, c in whole.items())])
    if rows:
        assert np.abs(sizes - sizes.sum() / shards).max() <= largest
    return counts


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert held(op9_hilbert_sharding(spark, sf_dir).collect(), texts, 24, True) == len(texts)
    assert held(shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), texts, 24) == len(texts)


def test_odd_rows(spark, documents, odd_rows):
    rows = shard(documents(odd_rows), 4).collect()
    assert held([r for r in rows], {i: t for i, t, _ in odd_rows if i is not None}, 4) == len(odd_rows)
    assert shard(documents([])).count() == 0
    rows = shard(documents(odd_rows), 4, together=True).collect()
    assert held(rows, {i: t for i, t, _ in odd_rows if i is not None}, 4, True) == len(odd_rows)
    assert shard(documents([]), together=True).count() == 0


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_copies_stay_together_over_many_partitions(spark, documents, partitions):
    """Copies of every frequency, of all languages and sources, one text with a third of the rows."""
    texts = [f"text {i % 400 if i % 3 else 'hot'} " * (5 if i % 3 else 1) for i in range(1800)] + ["often"] * 100 + [None, ""] * 20
    docs = documents([]).sparkSession.createDataFrame([(i, t, f"l{i % 5}", f"s{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = shard(docs, 6, together=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert held(rows, dict(enumerate(texts)), 6, True) == len(texts)


def test_written_shards_hold_every_row(spark, documents, odd_rows, tmp_path):
    df = documents(odd_rows)
    write_shards(df, str(tmp_path / "out"), 3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(odd_rows) and set(df.columns) < set(got.columns)


def test_filters_on_each_dimension_read_few_shards(spark):
    """Shards whose least and greatest value let a filter in, against those that a hash of the document would let in: all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    placed = shard(docs).select("doc_id", "shard", "size").join(docs.select("doc_id", "lang", "source"), "doc_id").toPandas()
    left = {}
    for name in ("lang", "source", "size"):
        of = placed.groupby("shard")[name].agg(["min", "max"])
        values = sorted(placed[name].unique()) if name != "size" else list(placed[name].quantile([0.05, 0.25, 0.5, 0.75, 0.95]))
        left[name] = np.mean([((of["min"] <= v) & (of["max"] >= v)).sum() for v in values])
    assert left["lang"] < 15 and left["source"] < 15 and left["size"] < 15, left
    assert len(placed) == docs.count()
