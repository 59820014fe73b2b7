"""Trace curation: validity, pending work, mixing, splitting, ordering, batching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordering import positions


def cache_valid(prompt: Column, cached_prompt: Column, n_tokens: Column, passed: Column, max_tokens: Column, wanted: int, rejection: bool) -> Column:
    """Same prompt, some tokens, and a pass where one is required or the cached budget was smaller."""
    same = F.coalesce(prompt == cached_prompt, F.lit(False)) & (F.coalesce(n_tokens, F.lit(0)) > 0)
    done = F.coalesce(passed, F.lit(False))
    return same & (done | F.lit(not rejection)) & (done | (F.coalesce(max_tokens, F.lit(0)) >= wanted))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys without a finished row."""
    return wanted.join(done.select(key), key, "left_anti")


def cache_audit(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """(key, prompt) against (key, prompt, passed): matched / mismatched / missing x passing / failing counts."""
    both = wanted.join(cached.select(key, F.col("prompt").alias("_p"), F.col("passed").alias("_ok"), F.lit(True).alias("_here")), key, "left")
    state = F.when(F.col("_here").isNull(), "missing").when(F.col("_p") == F.col("prompt"), "matched").otherwise("mismatched")
    return both.groupBy(state.alias("state"), F.coalesce("_ok", F.lit(False)).alias("passing")).agg(F.count("*").alias("n"))


def monotone_upsert(old: DataFrame, new: DataFrame, key: str, passed: str) -> DataFrame:
    """The newer row of each key, unless it would replace a passing one by a failing one. One aggregation over the union, no outer join."""
    columns = [c for c in old.columns if c != key]
    rows = old.select(key, F.struct(*columns).alias("row"), F.lit(0).alias("version")).unionByName(new.select(key, F.struct(*columns).alias("row"), F.lit(1).alias("version")))
    best = F.max_by("row", F.struct(F.coalesce(F.col(f"row.{passed}"), F.lit(False)), "version"))
    return rows.groupBy(key).agg(best.alias("row")).select(key, "row.*")


def last_writer_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """Merge keyed tables; of a key that several hold, the row of the last."""
    columns = [c for c in tables[0].columns if c != key]
    rows = reduce(DataFrame.unionByName, [t.select(key, F.struct(*columns).alias("row"), F.lit(i).alias("at")) for i, t in enumerate(tables)])
    return rows.groupBy(key).agg(F.max_by("row", "at").alias("row")).select(key, "row.*")


def fits(prompt: Column, response: Column, max_length: int) -> Column:
    """Prompt capped at max_length - 1, response and one end token fit."""
    return F.least(prompt, F.lit(max_length - 1)) + response + 1 <= max_length


def truncated(prompt: Column, response: Column, max_length: int) -> list[Column]:
    p = F.least(prompt, F.lit(max_length - 1))
    return [p.alias("prompt_kept"), F.least(response, max_length - p).alias("response_kept")]


def curriculum(rows: DataFrame, length: str, key: str) -> DataFrame:
    """Place of each row by length and key, from 0."""
    return positions(rows, [length, key])


def split_at(rows: DataFrame, place: str, ratio: float) -> DataFrame:
    """train for the first int(n ratio) places, val for the rest."""
    n = rows.agg(F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col(place) < F.floor(F.col("_n") * F.lit(ratio)), "train").otherwise("val")).drop("_n")


def chunk(place: Column, size: int) -> Column:
    return F.floor(place / size).cast("bigint")


def leak_free(short: DataFrame, val: DataFrame, problem: Column, key: str) -> DataFrame:
    """Drop rows whose derived problem is in the validation keys."""
    return short.withColumn("problem", problem).join(val.select(F.col(key).alias("problem")), "problem", "left_anti")


def short_key(problem: Column, sample: Column) -> Column:
    return 1_000_000 + problem * 100 + sample


def problem_of(key: Column) -> Column:
    """The problem of a short key; other keys are problems themselves."""
    return F.when(key >= 1_000_000, F.floor((key - 1_000_000) / 100)).otherwise(key).cast("bigint")


def oversample(rows: DataFrame, hard: Column, times: int) -> DataFrame:
    """Hard rows `times` times, others once, by a generator instead of repeated unions."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(hard, F.lit(times - 1)).otherwise(F.lit(0)))))


def interleave(rows: DataFrame, key: str, wave: str, position: str, cap: int) -> DataFrame:
    """Round-robin over waves: of each key the first `cap` rows by position, then wave."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(position, wave))
    return rows.withColumn("nth", nth).where(F.col("nth") <= cap)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same on every run: the least by a seeded hash, a top-k and no full sort."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def padded(arrays: DataFrame, by: str, ids: str, pad: int) -> DataFrame:
    """Pad ids to the longest of their batch, with mask and labels (-100 where padded)."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(by))
    room = longest - F.size(ids)
    return arrays.select(
        "*", F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), room)).alias("input_ids"),
        F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), room)).alias("mask"),
        F.concat(ids, F.array_repeat(F.lit(-100).cast("bigint"), room)).alias("labels"),
    )


def label_mask(prompt: Column, response: Column) -> Column:
    """-100 for the prompt, then the response."""
    return F.concat(F.transform(prompt, lambda _: F.lit(-100).cast("bigint")), response)


def shift_left(mask: Column) -> Column:
    """Element t becomes element t + 1; the last is false."""
    return F.when(F.size(mask) > 0, F.concat(F.slice(mask, F.lit(2), F.size(mask)), F.array(F.lit(False)))).otherwise(mask)


def numeric_name_order(name: Column) -> Column:
    """Sort key of file stems: the number, non-numeric ones last."""
    return F.coalesce(name.try_cast("int"), F.lit(1 << 30))


def difficulties(column: Column, spec: str) -> Column:
    """Rows of the difficulties that a spec such as "easy+hard" or "Easy, medium" lists; `all` lets every row pass."""
    wanted = [x.strip().lower() for x in spec.replace("+", ",").split(",") if x.strip()]
    return F.lit(True) if "all" in wanted else F.lower(column).isin(wanted)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Each row's place in a seeded order that is the same on every run and for any partitioning: by a hash of the key."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return positions(hashed, ["_h", key]).drop("_h")


def invalid(rows: DataFrame, ok: Column) -> DataFrame:
    """Rows for which a check fails or is unknown."""
    return rows.where(~F.coalesce(ok, F.lit(False)))


def calibration(rows: DataFrame, place: str, length: str, train: int, longest: int, n: int) -> DataFrame:
    """The first n rows of the training prefix that are not longer than `longest`."""
    return rows.where((F.col(place) < train) & (F.col(length) <= longest)).orderBy(place).limit(n)
