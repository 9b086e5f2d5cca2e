"""A file source that sees every name, a leading _ or . included, and deals its work in parts of bounded size.

Planning reads names only: folders are opened on the driver, breadth first, until there
are SPREAD of them; the files met so far are dealt in chunks of CHUNK names, and the
folders not yet opened in groups that tasks walk.  Sizes, times and contents are read in the tasks.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names of a part, folders that planning opens, parts that walk folders, and bytes of a batch of contents.
CHUNK = 1000
SPREAD = 256
WALKERS = 1024
BATCH_BYTES = 32 << 20


def place(root: str) -> tuple[fs.FileSystem | None, str]:
    """The file system of a root (None: the local one) and its absolute path there."""
    scheme, sep, rest = root.partition("://")
    if sep and scheme != "file":
        return fs.FileSystem.from_uri(root)
    if root.startswith("file:"):
        root = "/" + (rest if sep else root.removeprefix("file:")).lstrip("/")
    return None, os.path.abspath(root)


def _children(system: fs.FileSystem | None, folder: str) -> Iterator[tuple[str, bool]]:
    """Paths in a folder and whether they are folders; a folder that has gone is empty."""
    if system is not None:
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            yield info.path, info.type == fs.FileType.Directory
        return
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                yield entry.path, entry.is_dir(follow_symlinks=False)
    except (FileNotFoundError, PermissionError):
        return


@dataclass
class Part(InputPartition):
    files: list[str]
    folders: list[str]


class PhotoReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.root = options["path"]
        self.deep = options.get("recursive", "true").lower() == "true"
        self.full = "content" in schema.names
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self) -> list[Part]:
        system, root = place(self.root)
        if system is None and os.path.isfile(root):
            return [Part([root], [])]
        files, waiting, opened = [], deque([root]), 0
        while waiting and opened < SPREAD:
            opened += 1
            for path, is_folder in _children(system, waiting.popleft()):
                if not is_folder:
                    files.append(path)
                elif self.deep:
                    waiting.append(path)
        files.sort()
        step = max(1, -(-len(waiting) // WALKERS))
        folders = list(waiting)
        return [Part(files[i : i + self.chunk], []) for i in range(0, len(files), self.chunk)] + [Part([], folders[i : i + step]) for i in range(0, len(folders), step)] or [Part([], [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.root)
        names = ["path", "file_name", "file_size", "modified"] + (["content"] if self.full else [])
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()] + ([pa.binary()] if self.full else [])
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) if held else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for path in self._walked(system, partition):
            row = self._row(system, path)
            if row is not None:
                held.append(row)
                size += 200 + (len(row[4]) if self.full else 0)
            if size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        yield batch()

    @staticmethod
    def _walked(system: fs.FileSystem | None, partition: Part) -> Iterator[str]:
        yield from partition.files
        waiting = list(partition.folders)
        while waiting:
            for path, is_folder in _children(system, waiting.pop()):
                if is_folder:
                    waiting.append(path)
                else:
                    yield path

    def _row(self, system: fs.FileSystem | None, path: str) -> tuple | None:
        """None where the file has gone or is no regular file."""
        try:
            if system is None:
                if not os.path.isfile(path):
                    return None
                stat = os.stat(path)
                row = path, os.path.basename(path), stat.st_size, stat.st_mtime_ns // 1000
                if self.full:
                    with open(path, "rb") as handle:
                        row += (handle.read(),)
                return row
            info = system.get_file_info(path)
            if info.type != fs.FileType.File:
                return None
            row = path, info.base_name, info.size, (info.mtime_ns or 0) // 1000
            if self.full:
                with system.open_input_stream(path) as handle:
                    row += (handle.read(),)
            return row
        except FileNotFoundError:
            return None


class PhotoFiles(DataSource):
    """path, file_name, file_size, modified (epoch micros) and, where the schema asks for it, content."""

    @classmethod
    def name(cls) -> str:
        return "photo_files"

    def schema(self) -> str:
        return "path string, file_name string, file_size long, modified long"

    def reader(self, schema) -> PhotoReader:
        return PhotoReader(self.options, schema)


def files_below(spark: SparkSession, root: str, recursive: bool = True, content: bool = False, chunk: int = CHUNK) -> DataFrame:
    """All files below a root (or the one file that it is); no rows where there is none."""
    spark.dataSource.register(PhotoFiles)
    reader = spark.read.format("photo_files").option("recursive", recursive).option("chunk", chunk)
    if content:
        reader = reader.schema("path string, file_name string, file_size long, modified long, content binary")
    system, path = place(root)  # here, since a relative root belongs to the driver's own folder
    return reader.load(path if system is None else root)


def binary_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """The same files in the columns of Spark's binaryFile source, which leaves out names with a leading _ or .."""
    found = files_below(spark, root, recursive, content=True)
    return found.select(
        F.concat(F.lit("file://" if place(root)[0] is None else ""), "path").alias("path"), F.timestamp_micros("modified").alias("modificationTime"), F.col("file_size").alias("length"), "content"
    )


def hidden(name: str) -> bool:
    """Whether Spark's own file sources leave a file out for its name."""
    return name.startswith(("_", "."))
