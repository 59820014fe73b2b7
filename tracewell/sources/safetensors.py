"""A data source for safetensors files: spark.read.format("safetensors").load(path).

Each row is one row of a matrix (or a whole vector): name, row, dtype, values. A file's header is a length of 8 bytes and
JSON with each tensor's type, shape and byte range. Planning reads headers alone; a partition is one byte range of about `bytesPerPartition`, so
shards are read in parallel and no tensor need fit in one task. Filters on name (equal, in) take tensors out before any of their bytes are read.
Rows leave Python as Arrow batches. Files may be on any store that pyarrow opens.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from tracewell.sources.stores import listing, opened

_KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1", "BF16": "<u2"}
_COLUMNS = ["name", "row", "dtype", "values"]


def header(path: str, system: fs.FileSystem | None = None) -> tuple[dict, int]:
    """Tensor descriptions and the offset of the data; path is an address, or a path in `system`."""
    system, inner = (system, path) if system else opened(path)
    with system.open_input_file(inner) as f:
        (n,) = struct.unpack("<Q", f.read_at(8, 0))
        found = json.loads(f.read_at(n, 8))
    found.pop("__metadata__", None)
    return found, 8 + n


def decode(raw: bytes, dtype: str) -> np.ndarray:
    """Numbers as doubles; bfloat16 is the upper half of a float."""
    a = np.frombuffer(raw, _KINDS[dtype])
    if dtype == "BF16":
        a = (a.astype(np.uint32) << 16).view(np.float32)
    return a.astype(np.float64)


@dataclass
class _Block(InputPartition):
    path: str
    name: str
    dtype: str
    start: int
    first: int
    rows: int
    width: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.rows, self.bytes = int(options.get("rowsperpartition", 0)), int(options.get("bytesperpartition", 64 << 20))
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            elif not isinstance(f, IsNotNull):  # no column has nulls
                yield f

    def partitions(self) -> list[_Block]:
        found, (system, _) = [], opened(self.path)
        for path, _ in listing(self.path, ".safetensors"):
            tensors, data = header(path, system)
            for name, t in sorted(tensors.items()):
                if self.names is not None and name not in self.names:
                    continue
                shape = t["shape"] or [1]
                rows, width = (1, shape[0]) if len(shape) == 1 else (shape[0], int(np.prod(shape[1:])))
                step = width * np.dtype(_KINDS[t["dtype"]]).itemsize
                many = self.rows or max(1, self.bytes // max(step, 1))
                for at in range(0, rows, many):
                    found.append(_Block(path, name, t["dtype"], data + t["data_offsets"][0] + at * step, at, min(many, rows - at), width))
        return found or [_Block("", "", "F32", 0, 0, 0, 0)]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        step = partition.width * np.dtype(_KINDS[partition.dtype]).itemsize
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f:
            for at in range(0, partition.rows, many := max(1, (8 << 20) // max(step, 1))):
                n = min(many, partition.rows - at)
                values = decode(f.read_at(n * step, partition.start + at * step), partition.dtype)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * partition.width, pa.int32()), pa.array(values))
                places = pa.array(np.arange(partition.first + at, partition.first + at + n), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * n), places, pa.array([partition.dtype] * n), lists], _COLUMNS)


class Safetensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return "name string, row int, dtype string, values array<double>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, shard, dtype, shape) of all tensors of a file or folder: headers are read in tasks."""
    files = listing(path, ".safetensors")  # a row for each shard

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(path)
        for batch in batches:
            rows = [(name, f, t["dtype"], t["shape"]) for f in batch.column("shard").to_pylist() for name, t in sorted(header(f, system)[0].items())]
            for part in (rows,) if rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())))], ["name", "shard", "dtype", "shape"])

    return spark.createDataFrame([(f,) for f, _ in files], "shard string").repartition(max(1, min(len(files), 200))).mapInArrow(heads, "name string, shard string, dtype string, shape array<bigint>")


def packed(tensors: dict[str, np.ndarray]) -> bytes:
    """A file's bytes: float arrays are stored as F32."""
    parts, at, raw = {}, 0, []
    for name, a in tensors.items():
        b = np.asarray(a, "<f4").tobytes()
        parts[name] = {"dtype": "F32", "shape": list(a.shape), "data_offsets": [at, at + len(b)]}
        at += len(b)
        raw.append(b)
    head = json.dumps(parts).encode()
    return struct.pack("<Q", len(head)) + head + b"".join(raw)


def write(path: str, tensors: dict[str, np.ndarray]) -> None:
    system, inner = opened(path)
    with system.open_output_stream(inner) as out:
        out.write(packed(tensors))


def write_shards(rows: DataFrame, folder: str) -> int:
    """Store rows (name, values: vectors of one width) as shards, written by the tasks that hold them: of each task's batch a shard with a matrix for each name. Returns the number of rows."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, inner = opened(folder)
        system.create_dir(inner, recursive=True)
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            names = np.array(batch.column("name").to_pylist(), dtype=object)
            values = batch.column("values")
            flat = np.asarray(values.flatten(), dtype="<f4").reshape(len(names), -1)
            found = {name: flat[names == name] for name in dict.fromkeys(names)}
            with system.open_output_stream(f"{inner}/shard-{part:05d}-{k:05d}.safetensors") as out:
                out.write(packed(found))
            yield pa.RecordBatch.from_pydict({"n": [len(names)]})

    return rows.select("name", "values").mapInArrow(shards, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
