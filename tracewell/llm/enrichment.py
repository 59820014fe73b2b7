"""Sales enriched with the version of their client that was valid when they were made, as a stateful stream.

Sales and changes come in batches. A table's watermark is its greatest event time of earlier batches less `DELAY`; the smaller is the
horizon H. In every batch changes below their own table's watermark are late, the others become versions of their client; then sales
without a time or below H are released, others wait; then of each client's versions up to H all but the last are pruned. A released
sale takes the last version, by (valid_at, change_id), that is not pruned and not after the sale. What still waits at the end is released then.

The query is started anew for each batch on one checkpoint. Each table's rows carry the greatest event time so far, which is never late, as the column that
Spark watches; of the two watermarks Spark takes the minimum, which is H in the next start. Event-time timers (timeouts of group state) do the rest:
one for each shard at the earliest time at which a sale of it is due or a version of it can be pruned. A batch without rows of a table has one row
that carries the time alone.

State is held by Spark's file-backed store, in the heap and only while its task runs. Every start opens a store for each partition, and Spark 4.1's RocksDB
store, which `transformWithState` asks for, leaves about half a MB outside the heap for each store that it has closed.

A shard is a group of clients, about `SHARD_ROWS` rows a batch, and there are as many as the tables' size asks for. Its state is two Arrow tables: versions,
and waiting sales. A client of more than `SLICE_ROWS` rows is cut by event time into slices of about as many (whole hours), which are dealt
to shards each for itself. A sale visits only the slice of its own time; what the client's other slices hold is told in one row for each slice and
change, and is put together afterwards: the count of all slices, and the last version of the slices before. In a slice what has been
pruned down to is marked, since of all slices only the last such version counts. So no key is larger than its part of a shard.

Nulls: a sale without a time is released at once and takes no version; one without a client, or with one that has no versions, holds
0; a change without valid_at is ignored, one without a client is a version of nobody's, but can be late. Repeated changes count once; each
repeated sale is a sale. Versions of equal (valid_at, change_id) follow by balance, then op. Times have the resolution of Spark's watermark,
a millisecond. Empty tables give no rows.
"""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.llm.common import settle
from tracewell.sources import scratch

DELAY_HOURS = 24
SHARD_ROWS, SLICE_ROWS = 8192, 4096
#: Of a batch there are at least so many files, and one for so many shards.
FILES, FILE_SHARDS = 8, 32
HOUR = 3_600_000_000
#: The watched times are moved by so many microseconds (100 years of 365.25 days), so that all since 1870 are positive and a watermark of 0 means none yet.
#: pandas ends in 2262, so the latest times of both tables have to be before 2160.
SHIFT = 100 * 8766 * HOUR
#: In place of a null in a column of integers.
NONE = -(1 << 62)
FEED = "shard int, kind string, client long, slice long, id long, at long, cents long, op string"
OUT = "rec string, id long, batch long, n_held long, change_id long, cents long, op string, client long, slice long, at long, sold long"
_VERSION = ["client", "slice", "at", "id", "cents", "op"]
_SALE = ["client", "slice", "at", "id"]
_INTS = ["n_held", "change_id", "cents", "client", "slice", "at", "sold"]


def micros(at: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, or of one with in the session's zone."""
    return F.expr(f"datediff(cast({at} as date), date'1970-01-01') * 86400000000 + hour({at}) * {HOUR} + minute({at}) * 60000000L + cast(extract(second from {at}) * 1000000 as bigint)")


def batch_of(day: Column, batches: int, first_day: int = 19723, days: int = 152) -> Column:
    """The batch of a day since 1970: equal parts of the time from first_day on; what is before is in the first batch, what is after or null in the last."""
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first_day) * batches / days))).cast("int")


def _blob(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _rows(blob: bytes | None, columns: list[str]) -> pd.DataFrame:
    if blob is None:
        return pd.DataFrame({c: pd.Series(dtype="bool" if c == "kept" else "object" if c == "op" else "int64") for c in columns})
    return pa.ipc.open_stream(blob).read_all().to_pandas()


def last_versions(sales: pd.DataFrame, versions: pd.DataFrame) -> np.ndarray:
    """For each sale with a time the row of versions, which are sorted, that is its client's and slice's last up to then; -1 without one."""
    n, m = len(versions), len(sales)
    both = [np.concatenate([versions[c].to_numpy(), sales[c].to_numpy()]) for c in ("client", "slice", "at")]
    rank = np.concatenate([np.arange(n), np.full(m, n)])
    order = np.lexsort((rank, both[2], both[1], both[0]))
    place = np.maximum.accumulate(np.where(order < n, np.arange(n + m), -1))
    found = np.where(place >= 0, order[place], -1)
    same = (found >= 0) & (both[0][found] == both[0][order]) & (both[1][found] == both[1][order])
    out, own = np.full(m, -1), order >= n
    out[order[own] - n] = np.where(same, found, -1)[own]
    return np.where(sales["at"].to_numpy() == NONE, -1, out)


class Enricher:
    """Of one shard: keeps versions and waiting sales, releases and prunes when rows come or the timer says so."""

    def __init__(self, batch: int, end: int):
        self.batch, self.end = batch, end

    def __setstate__(self, fields: dict) -> None:
        """In a Python worker, which collects its garbage after every task, also after those without a shard: the modules' objects are left out."""
        self.__dict__.update(fields)
        if not gc.get_freeze_count():
            gc.freeze()

    def step(self, key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = state.get if state.exists else (None, None)
        versions, sales = _rows(held, [*_VERSION, "kept"]), _rows(waiting, _SALE)
        now = state.getCurrentWatermarkMs()
        horizon = now * 1000 - SHIFT if now > 0 else NONE
        new = [r for r in rows if len(r)]
        if new:
            new = pd.concat(new, ignore_index=True)
            change, late = new["kind"] == "change", new["late"].astype(bool)
            yield self._out("late", new["id"][change & late])
            fresh = new[change & ~late & (new["client"] != NONE)][_VERSION].assign(kept=False)
            if len(fresh):
                versions = pd.concat([versions, fresh], ignore_index=True).sort_values(_VERSION, ignore_index=True, na_position="first")
                yield from self._told(versions, self.batch, 1)
            sales = pd.concat([sales, new[new["kind"] == "sale"][_SALE]], ignore_index=True)
        due = (sales["at"] == NONE) | (sales["at"] < horizon)
        yield from self._released(sales[due], versions)
        past = (versions["at"] <= horizon).to_numpy(bool)
        if self.batch < self.end and (past & ~versions["kept"].to_numpy(bool)).any():
            last = past.copy()
            last[past] = ~versions[past].duplicated(["client", "slice"], keep="last").to_numpy(bool)
            versions = versions.assign(kept=versions["kept"].to_numpy(bool) | last)[~past | last].reset_index(drop=True)
            yield from self._told(versions, self.batch + 1, 0)
        self._keep(state, versions, sales[~due])

    def _keep(self, state: GroupState, versions: pd.DataFrame, sales: pd.DataFrame) -> None:
        """Store the state, and set the timer, which goes off once H is after it: a sale is due once H is after it, a version (unless it is what is left of earlier ones) once H has reached it."""
        state.update((_blob(versions), _blob(sales.reset_index(drop=True))))
        left = versions["at"][~versions["kept"].to_numpy(bool)]
        due = [(int(sales["at"].min()) + SHIFT) // 1000] if len(sales) else []
        due += [-(-(int(left.min()) + SHIFT) // 1000) - 1] if len(left) else []
        if due and self.batch < self.end:
            state.setTimeoutTimestamp(min(due))

    def _out(self, rec: str, ids, op=None, batch: int | None = None, **ints) -> pd.DataFrame:
        n = len(ids)
        rows = pd.DataFrame({"rec": pd.Series(np.full(n, rec, object), dtype=object), "id": np.asarray(ids, "int64"), "batch": np.full(n, self.batch if batch is None else batch, "int64")})
        rows = rows.assign(**{c: np.asarray(ints[c], "int64") if c in ints else np.full(n, NONE) for c in _INTS}, op=pd.Series(np.full(n, None, object) if op is None else op, dtype=object))
        return rows[[c.split()[0] for c in OUT.split(", ")]]

    def _taken(self, versions: pd.DataFrame, found: np.ndarray) -> dict:
        """Columns of the versions found; nulls for -1."""
        have = found >= 0
        out = {name: np.full(len(found), NONE) for name in ("change_id", "cents", "at")} | {"op": np.full(len(found), None, object)}
        for name, c in (("change_id", "id"), ("cents", "cents"), ("at", "at"), ("op", "op")):
            out[name][have] = versions[c].to_numpy(dtype=out[name].dtype)[found[have]]
        return out

    def _released(self, sales: pd.DataFrame, versions: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """In a slice, what pruning has left is no candidate here: another slice may hold a later one."""
        if len(sales):
            usable = versions[(versions["slice"] == NONE) | ~versions["kept"].to_numpy(bool)].reset_index(drop=True)
            held = sales["client"].map(versions[versions["slice"] == NONE].groupby("client").size()).fillna(0)
            yield self._out("sale", sales["id"], n_held=held, client=sales["client"], slice=sales["slice"], sold=sales["at"], **self._taken(usable, last_versions(sales, usable)))

    def _told(self, versions: pd.DataFrame, batch: int, phase: int) -> Iterator[pd.DataFrame]:
        """Of each slice, from a batch on: how many versions it holds besides the one that pruning left, and the last of them (`others`), and that one (`kept`)."""
        mine = versions[versions["slice"] != NONE]
        if not len(mine):
            return
        keys = mine[["client", "slice"]].drop_duplicates()
        for rec, part in (("others", mine[~mine["kept"].to_numpy(bool)]), ("kept", mine[mine["kept"].to_numpy(bool)])):
            last = part.drop_duplicates(["client", "slice"], keep="last").reset_index(drop=True)
            count = part.groupby(["client", "slice"], as_index=False).size()
            rows = keys.merge(count, "left", ["client", "slice"]).merge(last[["client", "slice"]].assign(row=np.arange(len(last))), "left", ["client", "slice"])
            found = rows["row"].fillna(-1).astype("int64").to_numpy()
            yield self._out(rec, np.full(len(rows), phase), batch=batch, n_held=rows["size"].fillna(0), client=rows["client"], slice=rows["slice"], **self._taken(last, found))


def _sliced(rows: DataFrame) -> DataFrame | None:
    """(client, hour, slice) of clients with more than SLICE_ROWS rows, hours in order, to be broadcast if they are few; None without such clients. rows: client, at."""
    hours = rows.where("client is not null").groupBy("client", F.coalesce(F.floor(F.col("at") / HOUR), F.lit(NONE)).alias("hour")).agg(F.count("*").alias("n"))
    client = Window.partitionBy("client").orderBy("hour")
    sums = {"all": F.sum("n").over(client.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "before": F.sum("n").over(client.rowsBetween(Window.unboundedPreceding, -1))}
    found = hours.withColumns(sums).where(F.col("all") > SLICE_ROWS)
    found = settle(found.select("client", "hour", F.floor(F.coalesce("before", F.lit(0)) / SLICE_ROWS).cast("long").alias("slice")))
    n = found.count()
    return (F.broadcast(found) if n <= 200_000 else found) if n else None  # of 24 bytes each


def _feed(rows: DataFrame, slices: DataFrame | None, shards: int, batches: int, path: str) -> DataFrame:
    """Write rows (kind, client, id, at, cents, op, batch) by batch, with a shard, and a row of no client for each batch. Rows of a batch and some shards
    meet in one file, else each task would write one for every batch, which each start has to list and open."""
    rows = rows.withColumn("hour", F.coalesce(F.floor(F.col("at") / HOUR), F.lit(NONE)))
    if slices is None:
        rows = rows.withColumn("slice", F.lit(NONE))
    else:
        rows = rows.join(slices, ["client", "hour"], "left")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("client", "slice"), F.lit(shards)).cast("int"))
    marks = rows.sparkSession.range(batches + 1).select(F.col("id").cast("int").alias("batch"), F.lit("mark").alias("kind"), F.lit(0).alias("shard"))
    columns = [c.split()[0] for c in FEED.split(", ")]
    fed = rows.select(*columns, "batch").unionByName(marks, allowMissingColumns=True)
    fed = fed.withColumns({c: F.coalesce(c, F.lit(NONE)) for c in ("client", "slice", "id", "at", "cents")})
    fed.repartition("batch", F.pmod("shard", F.lit(max(FILES, shards // FILE_SHARDS)))).write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _combined(parts: DataFrame, slices: DataFrame, batches: int) -> DataFrame:
    """Sales of sliced clients with the count of all slices of their client, and the last of three: the version from their own slice, the last of the
    slices before (slices are in the order of time), and the one version of the client that pruning has left, if it is not after the sale."""
    version = F.when(F.col("at").isNotNull(), F.struct("at", "change_id", "cents", "op"))
    told = parts.where("rec <> 'sale'").withColumn("v", version).groupBy("client", "slice", "batch", F.col("id").alias("phase"))
    told = told.agg(*[F.max(F.when(F.col("rec") == rec, F.col(c))).alias(name) for rec, c, name in (("others", "n_held", "n"), ("others", "v", "last"), ("kept", "v", "kept"))])
    until = F.coalesce(F.lead("batch").over(Window.partitionBy("client", "slice").orderBy("batch", "phase")), F.lit(batches + 1)) - 1
    told = told.withColumn("until", until).where("until >= batch").select("client", "slice", F.explode(F.sequence("batch", "until")).alias("batch"), "n", "last", "kept")
    grid = slices.select("client", "slice").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches).cast("long"))).alias("batch"))
    client = Window.partitionBy("client", "batch")
    before = client.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    state = grid.join(told, ["client", "slice", "batch"], "left").select(
        "client", "slice", "batch", F.coalesce(F.sum("n").over(client), F.lit(0)).alias("n"), F.max("kept").over(client).alias("kept"), F.max("last").over(before).alias("before")
    )
    sales = parts.where("rec = 'sale'").select("rec", "id", "client", "slice", "batch", "sold", version.alias("own")).join(state, ["client", "slice", "batch"], "left")
    best = F.when(F.col("sold").isNotNull(), F.greatest("own", "before", F.when(F.col("kept.at") <= F.col("sold"), F.col("kept"))))
    sales = sales.withColumn("best", best)
    return sales.select("rec", "id", "batch", (F.col("n") + F.col("kept").isNotNull().cast("long")).alias("n_held"), *[F.col(f"best.{c}").alias(c) for c in ("change_id", "cents", "op")])


def enrich(sales: DataFrame, changes: DataFrame, batches: int) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op): each released sale and each late change.

    sales: sale_id, client_id, sold_at; changes: change_id, client_id, valid_at, balance, op; both with their batch, from 0. All that the stream needs is
    in a new folder under spark.checkpoint.dir. What comes to the driver is a row for each batch and table.
    """
    spark = sales.sparkSession
    folder = scratch.folder(spark, "enrichment")
    cents = F.when(F.abs("balance") < 1e15, F.floor(F.col("balance") * 100 + 0.5))
    no = F.lit(None)
    feeds = {
        "sales": sales.select(F.lit("sale").alias("kind"), F.col("client_id").alias("client"), F.col("sale_id").alias("id"), micros("sold_at").alias("at"), no.cast("long").alias("cents"), no.cast("string").alias("op"), "batch"),
        "changes": changes.where("valid_at is not null").select(F.lit("change").alias("kind"), F.col("client_id").alias("client"), F.col("change_id").alias("id"), micros("valid_at").alias("at"), cents.alias("cents"), "op", "batch"),
    }
    both = feeds["sales"].select("client", "at").unionAll(feeds["changes"].select("client", "at"))
    slices = _sliced(both)
    shards = max(16, both.count() // (SHARD_ROWS * batches))
    tops = {name: _tops(_feed(rows, slices, shards, batches, f"{folder}/{name}"), batches) for name, rows in feeds.items()}
    _stream(spark, folder, tops, batches)
    out = spark.read.schema(OUT).parquet(f"{folder}/out")
    out = out.withColumns({c: F.nullif(F.col(c), F.lit(NONE)) for c in ("id", *_INTS)})
    columns = ["rec", "id", "batch", "n_held", "change_id", F.col("cents").alias("balance_cents"), "op"]
    plain = out.where("rec = 'late' or rec = 'sale' and slice is null").select(*columns)
    return plain if slices is None else plain.unionByName(_combined(out.where("slice is not null"), slices, batches).select(*columns))


def _tops(feed: DataFrame, batches: int) -> list[int | None]:
    """The greatest event time up to each batch; null before there is one."""
    found = {r["batch"]: r["top"] for r in feed.groupBy("batch").agg(F.max(F.nullif("at", F.lit(NONE))).alias("top")).collect()}
    tops, top = [], None
    for batch in range(batches + 1):
        top = max((x for x in (top, found.get(batch)) if x is not None), default=None)
        tops.append(top)
    return tops


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """A folder to where a stream looks for files."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    to = path(target)
    system = to.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(to.getParent())
    if not system.rename(path(source), to):
        raise OSError(f"{source} cannot be moved to {target}")


def _stream(spark: SparkSession, folder: str, tops: dict[str, list[int | None]], batches: int) -> None:
    """One start for each batch, and one that releases what waits: after the last batch the watermark is beyond all rows."""
    beyond = max((t[-1] for t in tops.values() if t[-1] is not None), default=0) + 2 * DELAY_HOURS * HOUR
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store that stays open keeps its rows in the heap, for every start
        "spark.sql.streaming.stateStore.minDeltasForSnapshot": "4",  # a start reads so many batches' changes and a snapshot, not those of all batches
        "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # a second file beside each, made by threads of its own for every store; nobody comes back to this checkpoint
        "spark.sql.streaming.minBatchesToRetain": "2",  # a start needs the batch before it alone
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # a batch of its own for a new watermark would release sales too early
        "spark.sql.streaming.multipleWatermarkPolicy": "min",
    }
    with _set(spark, settings):
        for batch in range(batches + 1):
            sides = []
            for name, top in tops.items():
                mark = beyond if batch >= batches - 1 else top[batch]
                floor = top[batch - 1] if name == "changes" and batch and top[batch - 1] is not None else None
                late = F.col("at") < floor - DELAY_HOURS * HOUR if floor is not None else F.lit(False)
                _move(spark, f"{folder}/{name}/batch={batch}", f"{folder}/{name}-in/{batch}")
                rows = spark.readStream.schema(FEED).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}-in")
                seen = F.timestamp_micros(F.lit(DELAY_HOURS * HOUR if mark is None else mark + SHIFT))
                sides.append(rows.withColumns({"late": F.coalesce(late, F.lit(False)), "mark": seen}).withWatermark("mark", f"{DELAY_HOURS} hours"))
            rows = sides[0].unionByName(sides[1])
            out = rows.groupBy("shard").applyInPandasWithState(Enricher(batch, batches).step, OUT, "held binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def in_batches(sales: DataFrame, changes: DataFrame, batches: int) -> tuple[DataFrame, DataFrame]:
    """Sales by the day of their arrival; distinct changes by the day from which they hold, up to three days later by a hash of their id."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    delay = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")).cast("binary")) % 4
    changes = changes.distinct().where("valid_at is not null").withColumn("batch", batch_of(day("valid_at") + delay, batches))
    return sales.withColumn("batch", batch_of(day("arrived_at"), batches)), changes
