import random
import re
from collections import defaultdict

from tracewell.llm.line_dedup import line_dedup, stretches, without_repeats
from tracewell.llm.queries import op2_line_dedup


def brute(docs, min_words):
    """Every pair of equal lines extended as far as it goes: {doc_id: text left}."""
    split = [(i, t.split("\n")) for i, t in sorted(docs.items())]
    seen, out = defaultdict(list), {}
    for at, (doc_id, lines) in enumerate(split):
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        gone = set()
        for j, line in enumerate(lines):
            best = 0
            for other, k in seen[line]:
                theirs, n = split[other][1], 0
                while j + n < len(lines) and k + n < len(theirs) and lines[j + n] == theirs[k + n]:
                    n += 1
                best = max(best, n)
            if best and sum(words[j : j + best]) >= min_words:
                gone.update(range(j, j + best))
            seen[line].append((at, j))
        out[doc_id] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in op2_line_dedup(spark, sf_dir).collect()}
    assert got == brute(docs, 50)


def test_random_lines_against_brute_force(spark, documents):
    draw = random.Random(5)
    docs = {}
    for i in range(60):
        lines = [draw.choice(["a b", "c", "d e f", "", "g h i j"]) for _ in range(draw.randrange(1, 25))]
        docs[i] = "\n".join(lines)
    for i in range(60, 80):
        docs[i] = docs[draw.randrange(60)] + "\n" + docs[draw.randrange(60)]
    for min_words in (1, 4, 12):
        got = {r["doc_id"]: r["text"] for r in line_dedup(documents([(i, t, "s") for i, t in docs.items()]), min_words).collect()}
        assert got == brute(docs, min_words), min_words


def test_nested_runs_keep_the_longer_copy(spark, documents):
    a, b, c, d = ("\n".join(f"{x}{i} w w w w" for i in range(3)) for x in "abcd")
    rows = [(1, f"{a}\n{b}", "s"), (2, f"x\n{a}\n{b}\n{c}", "s"), (3, f"{a}\n{b}\n{c}\n{d}", "s")]
    got = {r["doc_id"]: r["text"] for r in line_dedup(documents(rows), 20).collect()}
    assert got == brute({i: t for i, t, _ in rows}, 20)
    assert got[2].startswith("x\n" + c[:4]) and got[3] == d


def test_repeated_rows_are_one_document(spark, documents):
    passage = " ".join(f"w{i}" for i in range(60))
    df = documents([(1, f"a\n{passage}", "s")] * 5000 + [(2, f"b\n{passage}\nc", "s")] * 5000)
    assert sorted((r["doc_id"], len(r["ids"])) for r in stretches(df, 50).collect()) == [(1, 2), (2, 3)]
    got = line_dedup(df).groupBy("doc_id", "text", "removed_lines").count().collect()
    assert {tuple(r) for r in got} == {(1, f"a\n{passage}", 0, 5000), (2, "b\nc", 1, 5000)}


def test_odd_rows(spark, documents, odd_rows):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [*odd_rows, (20, f"p\n{passage}\nq", "a"), (21, f"r\n{passage}\ns", "b"), (22, passage, "c")]
    df = documents(rows)
    got = line_dedup(df).collect()
    assert len(got) == len(rows) and set(df.columns) | {"removed_lines"} == set(got[0].asDict())
    by = {r["doc_id"]: r for r in got}
    assert (by[20]["text"], by[21]["text"], by[22]["text"]) == (f"p\n{passage}\nq", "r\ns", "")
    assert by[3]["text"] is None and by[3]["n_lines"] == 0 and by[21]["removed_lines"] == 1
    assert sum(r["doc_id"] is None for r in got) == 2
    kept = without_repeats(df).collect()
    assert 22 not in {r["doc_id"] for r in kept} and len(kept) == len(rows) - 1
    assert {r["doc_id"]: r["n_chars"] for r in kept}[21] == 3
    assert line_dedup(documents([])).count() == 0
