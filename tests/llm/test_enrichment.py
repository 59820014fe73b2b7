import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import pytest
from comparing import assert_same

from tracewell.llm import enrichment, queries
from tracewell.llm.oracles import ORACLES

SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, status string"
CHANGES = "change_id long, client_id long, valid_at timestamp_ntz, balance double, op string, seq long"
DAY, FIRST = timedelta(days=1), datetime(2024, 1, 1)


def batch(day, batches):
    return batches - 1 if day is None else max(0, min(batches - 1, (day - 19723) * batches // 152))


def day(at):
    return None if at is None else (at - datetime(1970, 1, 1)).days


def brute(sales, changes, batches):
    """One batch after another, with lists."""
    changes = {c for c in changes if c[2] is not None}
    at_sales = [batch(day(s[3]), batches) for s in sales]
    at_changes = {c: batch(day(c[2]) + zlib.crc32(str("" if c[0] is None else c[0]).encode()) % 4, batches) for c in changes}
    out, versions, waiting = [], [], []
    order = lambda v: (v[2], v[0] if v[0] is not None else -1, v[3] is not None, v[3] or 0, v[4] is not None, v[4] or "")
    mark = lambda times: max(times) - DAY if times else None

    def release(s, b):
        own = [v for v in versions if v[1] == s[1] and s[1] is not None]
        old = [v for v in own if s[2] is not None and v[2] <= s[2]]
        v = max(old, key=order) if old else None
        cents = None if v is None or v[3] is None else int((v[3] * 100 + 0.5) // 1)
        out.append(("sale", s[0], b, len(own), v and v[0], cents, v and v[4]))

    for b in range(batches):
        w_sales = mark([s[2] for s, k in zip(sales, at_sales) if k < b and s[2]])
        w_changes = mark([c[2] for c, k in at_changes.items() if k < b])
        h = None if w_sales is None or w_changes is None else min(w_sales, w_changes)
        for c in (c for c, k in at_changes.items() if k == b):
            if w_changes is not None and c[2] < w_changes:
                out.append(("late", c[0], b, None, None, None, None))
            else:
                versions.append(c)
        waiting += [s for s, k in zip(sales, at_sales) if k == b]
        due = [s for s in waiting if s[2] is None or h is not None and s[2] < h]
        waiting = [s for s in waiting if s not in due]
        for s in due:
            release(s, b)
        if h is not None:
            past = {}
            for v in versions:
                if v[2] <= h and (v[1] not in past or order(v) > order(past[v[1]])):
                    past[v[1]] = v
            versions = [v for v in versions if v[2] > h or past[v[1]] is v]
    for s in waiting:
        release(s, batches)
    return Counter(out)


def some(draw, n, clients):
    at = lambda most: FIRST + timedelta(hours=draw.randrange(0, most * 24), minutes=draw.choice([0, 0, 30]))
    sales, changes = [], []
    for i in range(n):
        sold = draw.choice([at(152)] * 20 + [None])
        arrived = None if draw.random() < 0.02 else (sold or at(152)) + timedelta(days=draw.choice([0, 0, 0, 1, 9, 40]))
        sales.append((i // 2 * 2 if draw.random() < 0.1 else i, draw.choice([*range(clients), 0, 0, None]), sold, arrived, "done"))
    for i in range(n):
        row = (i, draw.choice([*range(clients), 0, 0, None]), draw.choice([at(152)] * 20 + [None]), draw.choice([None, -0.005, 12.345, 7.0, draw.random() * 100]), draw.choice(["I", "U", "D", None]), i)
        changes += [row] * draw.choice([1, 1, 1, 2])
    return sales, [*changes, (n, 0, FIRST, 1.0, "U", 1), (n, 0, FIRST, 1.0, "U", 2)]


def run(spark, sales, changes, batches):
    s, c = enrichment.in_batches(spark.createDataFrame(sales, SALES).selectExpr("*", "1 as client", "'x' as kind").repartition(3), spark.createDataFrame(changes, CHANGES).selectExpr("*", "2 as slice", "3 as at"), batches)
    return Counter(map(tuple, enrichment.enrich(s, c, batches).collect()))


@pytest.mark.parametrize("slice_rows", [1_000_000, 12])
def test_random_tables(spark, monkeypatch, slice_rows):
    """Whole clients, and clients cut into slices of a few hours' rows."""
    monkeypatch.setattr(enrichment, "SLICE_ROWS", slice_rows)
    sales, changes = some(random.Random(slice_rows), 500, 9)
    got, want = run(spark, sales, changes, 4), brute(sales, changes, 4)
    assert got == want and sum(k[0] == "late" for k in want) >= 2 and len({k[2] for k in want}) >= 4


def test_empty_tables(spark):
    sales, changes = some(random.Random(2), 20, 3)
    assert run(spark, [], [], 2) == Counter()
    assert run(spark, sales, [], 2) == brute(sales, [], 2)


def test_small_table_against_sql(spark, sf_dir):
    assert_same(queries.op13_sale_enrichment(spark, sf_dir), ORACLES["op13_sale_enrichment"], sf_dir)


def test_state_is_kept_in_files_and_forgotten(spark, tmp_path, monkeypatch):
    """RocksDB leaves memory outside the heap for every store, of which there is one for each start and partition."""
    monkeypatch.setattr(enrichment.scratch, "folder", lambda spark, name: str(tmp_path / name))
    sales, changes = some(random.Random(3), 200, 5)
    assert run(spark, sales, changes, 8) == brute(sales, changes, 8)
    states = [[f.name for f in p.iterdir()] for p in (tmp_path / "enrichment/checkpoint/state/0").glob("[0-9]*")]
    assert len(states) == 8 and all(f.strip(".").endswith((".delta", ".snapshot", ".crc")) or f.startswith("_") for names in states for f in names)
    assert all(sum(f.endswith(".delta") for f in names) < 9 and any(f.endswith(".snapshot") for f in names) for names in states)


def test_a_start_opens_few_files_whatever_the_partitions(spark, tmp_path, monkeypatch):
    """Each task wrote a file for every batch, and each state file had a second one with its checksum."""
    monkeypatch.setattr(enrichment.scratch, "folder", lambda spark, name: str(tmp_path / name))
    sales, changes = some(random.Random(4), 400, 9)
    with enrichment._set(spark, {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        assert run(spark, sales, changes, 3) == brute(sales, changes, 3)
    folders = [p for name in ("sales", "changes") for p in (tmp_path / f"enrichment/{name}-in").iterdir()]
    assert len(folders) == 8 and all(1 <= len(list(p.rglob("*.parquet"))) <= 8 for p in folders)
    states = list((tmp_path / "enrichment/checkpoint/state/0").glob("[0-9]*"))
    assert len(states) == 24 and not any(f.name.endswith(".crc") and f.name[0] != "." for p in states for f in p.iterdir())


def test_a_worker_collects_no_modules(spark):
    """Workers collect their garbage after every task, most of it objects of modules, which took about 50 ms."""
    step = enrichment.Enricher(0, 1).step

    def frozen(batches, step=step):
        import gc

        yield from ((b.assign(id=int(gc.get_freeze_count() > 0)) for b in batches))

    assert {r["id"] for r in spark.range(4).mapInPandas(frozen, "id long").collect()} == {1}
