"""Greedy batches under a budget, by blocks of bounded size instead of a fold over a whole group.

A batch holds at most max_items rows, so all that a block of rows needs to know of those before it is which of its first
max_items rows begins a batch. A first pass maps each such entry to the entry into the next block; chaining these maps, a row for
each block, tells which entries occur; a second pass numbers the batches. Blocks have at least BLOCK rows and else the
square root of their number, so neither a block nor the chain outgrows a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordering import materialized, positions

BLOCK = 65536


def _ends(rows: pa.Table, own: int, by: str, length: str, max_items: int, budget: int) -> np.ndarray:
    """For each of the first `own` rows the place after the batch that would begin there."""
    group = rows[by].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    size = rows[length].cast(pa.int64()).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    at, longest, fits = np.arange(own), size[:own].copy(), np.ones(own, bool)
    ends = at + 1
    for more in range(1, min(max_items, len(size))):
        other = np.minimum(at + more, len(size) - 1)
        longest = np.maximum(longest, size[other])
        fits &= (at + more < len(size)) & (group[other] == group[:own]) & (longest * (more + 1) <= budget)
        if not fits.any():
            break
        ends[fits] += 1
    return ends


def _sorted(rows: pa.Table, block: int) -> tuple[pa.Table, int]:
    """Rows by place, and how many of them are the block's own; the rest are the beginning of the next."""
    rows = rows.sort_by("place")
    return rows, int(np.count_nonzero(rows["place"].to_numpy() // block == rows["block"][0].as_py()))


def _chart(rows: pa.Table, block: int, entries: int, **how) -> pa.Table:
    """Where each entry leaves the block, and how many batches begin on the way."""
    number = rows["block"][0].as_py()
    rows, own = _sorted(rows, block)
    exits, begun = [0] * own, [0] * own
    for i, end in reversed(list(enumerate(_ends(rows, own, **how).tolist()))):
        exits[i], begun[i] = (end - own, 1) if end >= own else (exits[end], begun[end] + 1)
    return pa.table({"block": [number], "exits": pa.array([exits[:entries]], pa.list_(pa.int64())), "begun": pa.array([begun[:entries]], pa.list_(pa.int64()))})


def _chain(charts: pa.Table) -> pa.Table:
    """The entry of each block, and how many batches begin before it."""
    entry = before = 0
    found = []
    for chart in charts.sort_by("block").to_pylist():
        found.append((chart["block"], entry, before))
        here = entry < len(chart["exits"])
        entry, before = (chart["exits"][entry], before + chart["begun"][entry]) if here else (0, before)
    blocks, entries, befores = zip(*found)
    return pa.table({"block": blocks, "entry": entries, "before": befores})


def _number(rows: pa.Table, block: int, keep: list[str], **how) -> pa.Table:
    """The block's own rows with the number of their batch among all."""
    rows, own = _sorted(rows, block)
    ends, begins = _ends(rows, own, **how).tolist(), np.zeros(own, np.int64)
    i = rows["entry"][0].as_py()
    while i < own:
        begins[i], i = 1, ends[i]
    batch = rows["before"][0].as_py() - 1 + np.cumsum(begins)
    return rows.slice(0, own).select(keep).append_column("batch", pa.array(batch, pa.int64()))


def pack_by_budget(rows: DataFrame, by: str, order: str, length: str, max_items: int, budget: int, block: int = BLOCK) -> DataFrame:
    """Greedy batches in order within each group: a new one if the count would exceed max_items or longest x count the budget; an oversized item is alone.

    Equal orders go by length; a null length counts as 0, and null is a group like others. Batches of a group count from 0.
    """
    placed = positions(rows.select(by, order, length), [by, order, length])
    total = placed.count()
    block = max(block, max_items, math.isqrt(total))
    here = F.floor(F.col("place") / block).cast("bigint")
    shared = (F.col("place") >= block) & (F.col("place") % block < max_items)
    blocks = placed.withColumn("block", F.explode(F.when(shared, F.array(here, here - 1)).otherwise(F.array(here))))
    how = {"by": by, "length": length, "max_items": max_items, "budget": budget, "block": block}
    charts = blocks.groupBy("block").applyInArrow(lambda rows: _chart(rows, entries=max_items, **how), "block bigint, exits array<bigint>, begun array<bigint>")
    entries = charts.groupBy().applyInArrow(_chain, "block bigint, entry bigint, before bigint")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(by, order, length).schema) + ", batch bigint"
    numbered = materialized(blocks.join(entries, "block").groupBy("block").applyInArrow(lambda rows: _number(rows, keep=[by, order, length], **how), schema))
    first = numbered.groupBy(F.col(by).alias("_by")).agg(F.min("batch").alias("_first"))
    return numbered.join(first, F.col(by).eqNullSafe(F.col("_by"))).select(by, order, length, (F.col("batch") - F.col("_first")).alias("batch"))
