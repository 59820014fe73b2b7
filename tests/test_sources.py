import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyspark.sql.datasource import EqualTo, GreaterThan, In

from tracewell.sources import file_ends, records, safetensors, sinks
from tracewell.streaming import run_log


def test_keyed_traces(spark, tmp_path):
    rows = {0: {"text": "a", "test_passed": 2, "test_total": 2}, 1: {"text": "b", "test_passed": 1, "test_total": 2}, 2: {"text": " ", "test_passed": 1, "test_total": 1}, 10: {"text": "c", "tokens": ["x"], "test_passed": 3, "test_total": 3}}
    for k, v in rows.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v, indent=1))
    (tmp_path / "11.json").write_text('{"text": "cut')
    (tmp_path / "notes.json").write_text("{}")
    folder = str(tmp_path)
    assert sorted(r["idx"] for r in records.traces(spark, folder).collect()) == [0, 10]
    assert sorted(r["idx"] for r in records.traces(spark, folder, False).collect()) == [0, 1, 10]
    assert records.lookup(spark, folder, 10).first()["text"] == "c"
    assert {r["stem"]: r["complete"] for r in records.complete(spark, folder).collect()}["11"] is False
    assert {r["idx"]: r["test_passed"] for r in records.tail_counts(spark, folder).collect()}[10] == 3


def test_short_traces_and_records(spark, tmp_path):
    (tmp_path / "s").mkdir(), (tmp_path / "e").mkdir()
    (tmp_path / "s/3.json").write_text(json.dumps({"prompt": "p", "attempts": 2, "texts": ["x", "y"]}))
    (tmp_path / "s/4.json").write_text(json.dumps({"prompt": "p", "texts": []}))
    (tmp_path / "e/m1.json").write_text(json.dumps({"name": "m", "per_problem": [{"idx": 1, "solved": True}, {"idx": 2, "solved": False}]}))
    (tmp_path / "plus.json").write_text(json.dumps({"eval": {"t/1": [{"plus_status": "pass"}], "t/2": [{"plus_status": "fail"}], "t/3": []}}))
    assert [(r["idx"], r["sample"], r["text"]) for r in records.short_traces(spark, str(tmp_path / "s")).orderBy("sample").collect()] == [(3, 0, "x"), (3, 1, "y")]
    assert sorted(map(tuple, records.eval_records(spark, str(tmp_path / "e")).collect())) == [("m1", 1, True), ("m1", 2, False)]
    assert {r["task"]: r["solved"] for r in records.plus_results(spark, str(tmp_path / "plus.json")).collect()} == {"t/1": True, "t/2": False, "t/3": None}


@pytest.mark.parametrize("value", [[1, 2, 5], {"ids": [5, 2, 1]}, [{"idx": 1}, {"id": 2}, {"idx": 5}], {"broken": [{"idx": 1}, {"idx": 2}, {"idx": 5}]}])
def test_id_lists(spark, tmp_path, value):
    (tmp_path / "ids.json").write_text(json.dumps(value))
    assert sorted(r["idx"] for r in records.id_list(spark, str(tmp_path / "ids.json")).collect()) == [1, 2, 5]


def test_report_and_sizes(spark, tmp_path):
    (tmp_path / "r.md").write_text("# R\n## Problem 7 (Easy): 3/5 samples passed\ntext\n## Problem 12: 0/5 samples passed\n")
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "b.bin").write_bytes(b"123")
    assert sorted(map(tuple, records.report_lines(spark, str(tmp_path / "r.md")).collect())) == [(7, 3), (12, 0)]
    assert [tuple(r) for r in records.folder_size(spark, str(tmp_path), [".bin"]).collect()] == [(".bin", 8)]


def test_safetensors(spark, tmp_path):
    a, b = np.arange(12, dtype=np.float32).reshape(4, 3), np.array([1.5, -2.0], dtype=np.float32)
    safetensors.write(str(tmp_path / "x.safetensors"), {"m.weight": a, "m.bias": b})
    spark.dataSource.register(safetensors.Safetensors)
    rows = spark.read.format("safetensors").option("rowsPerPartition", "3").load(str(tmp_path / "x.safetensors"))
    got = {(r["name"], r["row"]): r["values"] for r in rows.collect()}
    assert rows.rdd.getNumPartitions() == 3 and got[("m.weight", 3)] == [9.0, 10.0, 11.0] and got[("m.bias", 0)] == [1.5, -2.0]
    assert {r["name"]: r["shape"] for r in safetensors.catalog(spark, str(tmp_path)).collect()} == {"m.bias": [2], "m.weight": [4, 3]}
    assert safetensors.decode(np.array([0x3FC0], "<u2").tobytes(), "BF16").tolist() == [1.5]


def test_tensor_filters_are_pushed_and_shards_written_by_tasks(spark, tmp_path):
    folder = str(tmp_path / "shards")
    rows = spark.range(1000).select(F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("name"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("values"))
    assert safetensors.write_shards(rows.repartition(5), folder) == 1000 and len(list((tmp_path / "shards").iterdir())) == 5
    file_ends.register(spark, safetensors.Safetensors)
    got = spark.read.format("safetensors").load(folder).where("name = 't1'")
    assert sorted(r["values"][0] for r in got.collect()) == [float(i) for i in range(1, 1000, 4)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ") Filter" not in plan
    reader = safetensors._Reader({"path": folder})
    assert list(reader.pushFilters([EqualTo(("name",), "t1"), EqualTo(("row",), 1)])) == [EqualTo(("row",), 1)]
    assert {b.name for b in reader.partitions()} == {"t1"} and sum(b.rows for b in reader.partitions()) == 250
    assert {r["name"] for r in safetensors.catalog(spark, folder).collect()} == {"t0", "t1", "t2", "t3"}
    assert spark.read.format("safetensors").load(folder).where("name = 'none'").count() == 0


def test_only_the_ends_of_files_are_read(spark, tmp_path):
    """One file is larger than binaryFile can load, and sparse: reading it whole would take 3 GB."""
    for i in range(20):
        (tmp_path / f"{i}.json").write_text('{"prompt": "p", ' + "x" * 5000 + f' "test_passed": {i}, "test_total": 20}}')
    with open(tmp_path / "99.json", "wb") as f:
        f.seek(3 << 30)
        f.write(b'"test_passed": 7, "test_total": 9}')
    rows = file_ends.file_ends(spark, str(tmp_path), head=10, tail=400).collect()
    assert len(rows) == 21 and all(r["fetched"] == 410 for r in rows) and {r["stem"]: r["length"] for r in rows}["99"] > 3 << 30
    assert {r["idx"]: r["test_passed"] for r in records.tail_counts(spark, str(tmp_path)).collect()} == {**{i: i for i in range(20)}, 99: 7}
    assert all(r["complete"] for r in records.complete(spark, str(tmp_path)).collect())
    reader = file_ends._Reader({"path": str(tmp_path), "tail": "5", "filespersartition": "3"})
    assert list(reader.pushFilters([In(("stem",), (1, "3", "99")), GreaterThan(("length",), 10_000)])) == []
    assert [stem for p in reader.partitions() for stem, _ in p.files] == [str(tmp_path / "99.json")]
    few = file_ends.file_ends(spark, str(tmp_path)).where("stem = '3'")
    assert [r["stem"] for r in few.collect()] == ["3"] and few.rdd.getNumPartitions() == 1
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/e.json").write_text("")
    assert file_ends.file_ends(spark, str(tmp_path / "empty")).first()["tail"] == b"" and file_ends.file_ends(spark, str(tmp_path / "empty"), suffix=".none").count() == 0


def test_snapshot_is_written_once_for_a_fingerprint(spark, tmp_path):
    df = spark.range(3)
    assert sinks.snapshot(df, str(tmp_path), "a").count() == 3
    assert sinks.snapshot(spark.range(9), str(tmp_path), "a").count() == 3 and sinks.snapshot(spark.range(9), str(tmp_path), "b").count() == 9
    assert sinks.truncate(spark, str(tmp_path / "a")) and not sinks.truncate(spark, str(tmp_path / "a"))


def test_streamed_log_and_counters(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [
        [{"run": "r", "t": 1.0, "kind": "build_start", "pending": 3}, {"run": "r", "t": 2.0, "kind": "chunk", "chunk_pass": 2, "chunk_fail": 1, "fail_causes": {"timeout": 1}}],
        [{"run": "r", "t": 3.0, "kind": "chunk", "by_difficulty": {"Easy": {"pass": 4, "fail": 0}, "Hard": {"pass": 0, "fail": 2}}}, {"run": "q", "t": 1.0, "kind": "build_done", "minutes": 0.5}],
    ]
    for i, part in enumerate(lines):
        (src / f"{i}.jsonl").write_text("\n".join(map(json.dumps, part)) + "\nnot json\n")
    q = run_log.log_and_status(run_log.read_events(spark, str(src), 1), str(tmp_path / "log"), str(tmp_path / "status"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert {r["run"]: r["t"] for r in spark.read.parquet(str(tmp_path / "status/v=1")).collect()} == {"r": 3.0, "q": 1.0}
    c = run_log.counters(run_log.read_events(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cc")).trigger(availableNow=True).start()
    c.awaitTermination()
    assert {r["difficulty"]: (r["passed"], r["failed"]) for r in spark.table("counts").collect()} == {"?": (2, 1), "Easy": (4, 0), "Hard": (0, 2)}
    assert records.run_log(spark, str(src)).where(F.col("kind") == "chunk").count() == 2


def _cleaned(tokens):
    """What the reference makes of tokens: the places of those kept, None for the bridge."""
    text = "".join(tokens)
    at = [sum(map(len, tokens[:i])) for i in range(len(tokens))]
    first = lambda place: next((i for i, x in enumerate(at) if x >= place), len(tokens))
    opens, thought = text.find("```python"), text.find("</think>")
    ends = text.find("```", opens + 9)
    if opens < 0 or ends < 0 or first(opens) == len(tokens):
        return None
    code, stop = first(opens), first(ends + 3)
    keep = first(thought + 8) if 0 <= thought < opens else code
    return ([*range(keep), None] if keep < code else []) + list(range(code, stop))


def test_traces_are_cleaned(spark, tmp_path):
    cases = [
        ["<think>", "plan", "</think>", "\n", "Well, ", "```python", "\nx", " = 1\n", "```", " done"],
        ["a", "b</thi", "nk>c", "so", " ``", "`python\ny", "```", "z"],
        ["So ", "```python", "\nx\n", "``", "`\nmore", "</think>", "tail"],
        ["</think>", "```python\n", "x", "```"],
        ["no", " fence", " at </think>", " all"], ["```python", "\nopen"], ["x```python\ny```"], ["```python\n", "y", "```"],
        ["é", "😀</think>", "ü ", "```python\nß", "```", "end"], ["long "] * 200 + ["</think>", "mid", "```python\n"] + ["line\n"] * 200 + ["```", "z"],
    ]
    for i, tokens in enumerate(cases):
        n = range(len(tokens))
        row = {"text": "raw", "tokens": tokens, "logprobs": [{"a": float(k)} for k in n], "top_k_ids": [[k] for k in n], "test_passed": 1, "test_total": 1}
        (tmp_path / f"{i}.json").write_text(json.dumps(row | ({"top_k_vals": [[k + 0.5] for k in n]} if i % 2 else {})))
    got = {r["idx"]: r for r in records.traces(spark, str(tmp_path)).collect()}
    for i, tokens in enumerate(cases):
        kept, r = _cleaned(tokens), got[i]
        assert r["text"] == ("raw" if kept is None else "".join(r["tokens"]))
        kept = list(range(len(tokens))) if kept is None else kept
        assert r["tokens"] == ["\n" if k is None else tokens[k] for k in kept], i
        assert r["logprobs"] == [{} if k is None else {"a": float(k)} for k in kept] and r["top_k_ids"] == [[] if k is None else [k] for k in kept]
        assert r["top_k_vals"] == ([[] if k is None else [k + 0.5] for k in kept] if i % 2 else None)


def test_results_of_other_settings_are_made_anew(spark, tmp_path):
    grid, runs, part = spark.range(9).withColumnRenamed("id", "k"), [], F.col("k") % 3

    def work(cells):
        runs.append(sorted(r["k"] for r in cells.collect()))
        return cells

    get = lambda settings: sinks.grid_results(grid, part, work, str(tmp_path / "p"), str(tmp_path / "t"), 3, settings)
    sinks.grid_part(lambda c: c, grid.where(part == 1), str(tmp_path / "p"), 1, sinks.settings_key({"b": 2, "a": 1}))
    sinks.grid_part(lambda c: c, grid.where(part == 2), str(tmp_path / "p"), 2, sinks.settings_key({"a": 1, "b": 3}))
    assert get({"a": 1, "b": 2}).count() == 9 and runs == [[0, 3, 6], [2, 5, 8]]
    # A part whose manifest is missing was interrupted.
    grid.where(part == 0).write.parquet(str(tmp_path / "p/results/part=0"))
    runs.clear()
    assert get({"a": 1, "b": 2}).count() == 9 and len(runs) == 3


def test_snapshots_follow_their_sources(spark, tmp_path):
    source, builds = str(tmp_path / "in"), []
    spark.range(5).write.parquet(source)

    def build():
        builds.append(1)
        return spark.read.parquet(source)

    ask = lambda ids=None: sinks.fresh_snapshot(spark, str(tmp_path / "snap"), [source], build, ids)
    ids = spark.range(3)
    assert ask(ids)[1] and not ask(ids)[1] and not ask(spark.range(2, -1, -1))[1] and len(builds) == 1
    assert ask(spark.range(4))[1] and len(builds) == 2
    spark.range(2).write.mode("append").parquet(source)
    rows, made = ask(spark.range(4))
    assert made and rows.count() == 7
    file = next(f for f in (tmp_path / "in").iterdir() if f.name.startswith("part"))
    os.utime(file, (1, 1))
    assert ask(spark.range(4))[1] and not ask(spark.range(4))[1]


def test_counts_survive_a_stop_and_a_replay(spark, tmp_path):
    src, target, check = tmp_path / "in", str(tmp_path / "counts"), str(tmp_path / "check")
    src.mkdir()
    event = lambda d, p, f: json.dumps({"run": "r", "t": 1.0, "kind": "chunk", "by_difficulty": {d: {"pass": p, "fail": f}}})
    run = lambda: run_log.durable_counters(run_log.read_events(spark, str(src)), target, check).awaitTermination()
    counts = lambda: {r["difficulty"]: (r["passed"], r["failed"]) for r in run_log.newest(spark, target).collect()}
    (src / "0.jsonl").write_text(event("Easy", 1, 2) + "\n" + event("Hard", 0, 5) + "\n")
    run()
    assert counts() == {"Easy": (1, 2), "Hard": (0, 5)}
    (src / "1.jsonl").write_text(event("Easy", 10, 0) + "\n")
    run()  # a new start on the same checkpoint
    assert counts() == {"Easy": (11, 2), "Hard": (0, 5)}
    # The last batch was done but not committed when the driver died: it is run again under its number.
    versions = len(list((tmp_path / "counts").iterdir()))
    last = max(int(f.name) for f in (tmp_path / "check/commits").iterdir() if f.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if (tmp_path / "check/commits" / name).exists():
            (tmp_path / "check/commits" / name).unlink()
    run()
    assert counts() == {"Easy": (11, 2), "Hard": (0, 5)} and len(list((tmp_path / "counts").iterdir())) == versions
    (src / "2.jsonl").write_text(event("New", 1, 1) + "\n")
    run()
    assert counts() == {"Easy": (11, 2), "Hard": (0, 5), "New": (1, 1)}


def test_folders_of_many_files_are_listed_by_tasks(spark, tmp_path):
    """The plan knows the folders alone, and a scan of many small files takes few tasks."""
    for i in range(400):
        (tmp_path / f"f/{i // 10}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"f/{i // 10}/{i}.json").write_text(json.dumps({"text": f"t{i}", "prompt": "p", "texts": ["x"], "test_passed": 1, "test_total": 1}))
    folder = str(tmp_path / "f")
    parts = file_ends._Reader({"path": folder, "folderpartitions": "7"}).partitions()
    assert len(parts) == 7 and not any(p.files for p in parts) and sum(len(p.folders) for p in parts) == 40
    scans = [records.traces(spark, folder), records.short_traces(spark, folder), records.tail_counts(spark, folder), records.settings(spark, folder)]
    assert all(s.rdd.getNumPartitions() <= 40 for s in scans)
    assert sorted(r["idx"] for r in scans[0].collect()) == list(range(400)) == sorted(r["idx"] for r in scans[1].collect()) == sorted(r["idx"] for r in scans[2].collect())
    assert records.lookup(spark, folder, 123).first()["text"] == "t123" and records.lookup(spark, folder, 999).count() == 0


def test_record_files_are_parsed_once_and_odd_ones_as_before(spark, tmp_path):
    for name, body in {"1": b'\xef\xbb\xbf{"text": "bom"}', "2": b"", "3": b" \n", "4": b'{"text": "cut', "5": b"[]", "6": b'{\n"text": "a\xffb"\n}', "x7": b'{"text": "no number"}', "_8": b'{"text": "hidden"}'}.items():
        (tmp_path / f"{name}.json").write_bytes(body)
    rows = records.keyed_json(spark, str(tmp_path), "text string")
    good = {r["idx"]: r["text"] for r in rows.where("_corrupt is null").collect()}
    assert good[1] == "bom" and not {2, 3, 4, 6, 7, 8} & set(good)
    assert {4, 6} <= {r["idx"] for r in rows.where("_corrupt is not null").collect()} and {2, 3, 7, 8}.isdisjoint(r["idx"] for r in rows.collect())
    plan = records.traces(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_sizes_come_from_listings_of_tasks(spark, tmp_path):
    """Neither files nor their statuses come to the driver, which lists the folder itself."""
    for i in range(60):
        (tmp_path / f"{i}/deep").mkdir(parents=True)
        (tmp_path / f"{i}/deep/a.bin").write_bytes(b"12345")
        (tmp_path / f"{i}/_b.bin").write_bytes(b"1")
    (tmp_path / "c.bin").write_bytes(b"123")
    rows = records.folder_size(spark, str(tmp_path), [".bin"])
    assert [tuple(r) for r in rows.collect()] == [(".bin", 303)]
    assert "binaryFile" not in rows._jdf.queryExecution().executedPlan().toString()
