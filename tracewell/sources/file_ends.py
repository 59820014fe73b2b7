"""A data source for the two ends of large files: spark.read.format("file_ends").option("head", 64).option("tail", 400).load(folder).

Rows are (path, stem, length, head, tail, fetched). Of each file no more than the ends are fetched, by byte ranges; ends that overlap are fetched
as one. Many files make one partition. Filters on stem (equal, in) and on length are applied to the listing, before any file is opened.
The plan lists the folder itself alone: the folders in it are dealt to at most `folderPartitions` tasks, which list all that is below them, so millions of files in
folders never pass through the driver. With a tail of `WHOLE` bytes the rows hold whole files, of at most 2 GB each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tracewell.sources.stores import inside, listing, opened

#: A tail that takes the whole file, and how much goes into a batch of rows.
WHOLE, BATCH_ROWS, BATCH_BYTES = 1 << 40, 1024, 8 << 20
_SCHEMA = pa.schema([("path", pa.string()), ("stem", pa.string()), ("length", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("fetched", pa.int64())])
_TESTS = {
    EqualTo: lambda have, want: have == want, In: lambda have, want: have in want, GreaterThan: lambda have, want: have > want, GreaterThanOrEqual: lambda have, want: have >= want,
    LessThan: lambda have, want: have < want, LessThanOrEqual: lambda have, want: have <= want,
}


def stem_of(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[0]


@dataclass
class _Files(InputPartition):
    root: str
    files: list[tuple[str, int]]
    folders: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", "")
        self.head, self.tail, self.many, self.parts = (int(options.get(k.lower(), d)) for k, d in (("head", 0), ("tail", 400), ("filesPerPartition", 1024), ("folderPartitions", 256)))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("stem",), ("length",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            elif not isinstance(f, IsNotNull):  # no column has nulls
                yield f

    def _wanted(self, files: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
        have = lambda f: {"stem": stem_of(f[0]), "length": f[1]}
        return [f for f in files if all(_TESTS[kind](have(f)[name], want) for name, kind, want in self.tests)]

    def partitions(self) -> list[_Files]:
        files, folders = inside(self.root, self.suffix)
        files, dealt = self._wanted(files), min(len(folders), self.parts)
        parts = [_Files(self.root, files[i : i + self.many], []) for i in range(0, len(files), self.many)]
        return parts + [_Files(self.root, [], folders[k::dealt]) for k in range(dealt)] or [_Files(self.root, [], [])]

    def _ends(self, system, path: str, length: int) -> tuple:
        if self.head + self.tail == 0:  # the listing is all that is asked for
            return path, stem_of(path), length, b"", b"", 0
        with system.open_input_file(path) as f:
            if self.head + self.tail >= length:
                whole = f.read_at(length, 0) if length else b""
                return path, stem_of(path), length, whole[: self.head], whole[max(length - self.tail, 0) :] if self.tail else b"", length
            head = f.read_at(self.head, 0) if self.head else b""
            tail = f.read_at(self.tail, length - self.tail) if self.tail else b""
        return path, stem_of(path), length, head, tail, len(head) + len(tail)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(partition.root)
        below = (f for folder in partition.folders for f in self._wanted(listing(folder, self.suffix, system)))
        rows, size = [], 0
        for path, length in itertools.chain(partition.files, below):
            rows.append(self._ends(system, path, length))
            size += rows[-1][-1]
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


class FileEnds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_ends"

    def schema(self) -> str:
        return "path string, stem string, length long, head binary, tail binary, fetched long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Make Python sources known, with filters passed on to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in sources:
        spark.dataSource.register(s)


def file_ends(spark: SparkSession, folder: str, head: int = 0, tail: int = 400, suffix: str = ".json"):
    register(spark, FileEnds)
    tasks = 8 * spark.sparkContext.defaultParallelism
    return spark.read.format("file_ends").option("head", head).option("tail", tail).option("suffix", suffix).option("folderPartitions", tasks).load(folder)


def whole_files(spark: SparkSession, folder: str, suffix: str = ""):
    """(path, stem, value) of the files below a folder, or of one file, each as one text in UTF-8."""
    return file_ends(spark, folder, tail=WHOLE, suffix=suffix).select("path", "stem", F.col("tail").cast("string").alias("value"))
