"""Files as the tasks' Python sees them: one address for mounted paths and object stores, listings, and files written by tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/|/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _files(found: list[fs.FileInfo], suffix: str) -> list[tuple[str, int]]:
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


def listing(path: str, suffix: str = "", system: fs.FileSystem | None = None) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder whose names end so; hidden ones are left out. path is an address, or a path in system."""
    system, inner = (system, path) if system else opened(path)
    info = system.get_file_info(inner)
    return _files([info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True)), suffix)


def inside(path: str, suffix: str = "") -> tuple[list[tuple[str, int]], list[str]]:
    """What stands in a folder itself: its files as in listing(), and the folders in it; of a file, the file."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    return _files(found, suffix), sorted(f.path for f in found if f.type == fs.FileType.Directory)


def put_files(rows: DataFrame, folder: str) -> int:
    """Write each row (name, body: string or binary) as a file of the folder, in the tasks that hold the rows. A task that runs again writes the same files again."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        n, made = 0, set()
        for batch in batches:
            for name, body in zip(*[batch.column(c).to_pylist() for c in ("name", "body")]):
                target = f"{inner}/{name}"
                if (parent := target.rpartition("/")[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(target) as out:
                    out.write(body.encode() if isinstance(body, str) else body)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return rows.select("name", "body").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
