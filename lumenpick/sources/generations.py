"""Parquet stores that a crash cannot harm.

Rows are only ever written into folders of their own.  A version is a small file that names the
folders which make up the store; it appears by one rename, so readers see the old version or
the new one and nothing between.  `replace` publishes a version of new rows alone, `append` one of
the earlier folders and a new one: no earlier row is rewritten.  Folders of a write that
never became a version are read by nobody and go with `vacuum`.

One writer at a time: a second one that publishes the same version number fails and has changed nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Versions that stay readable behind the current one.
KEPT = 2
#: Appended folders after which `fold` rewrites the store into one.
FOLDED_AT = 64


class Store:
    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)  # noqa: SLF001
        self._system = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")  # noqa: SLF001

    def versions(self) -> list[int]:
        """Numbers of the published versions, ascending."""
        if not self._system.exists(self._path("versions")):
            return []
        names = [s.getPath().getName() for s in self._system.listStatus(self._path("versions"))]
        return sorted(int(n) for n in names if n.isdigit())

    def folders(self, version: int | None = None) -> list[str]:
        """The folders of a version, of the current one by default."""
        known = self.versions()
        if not known:
            return []
        stream = self._system.open(self._path(f"versions/{known[-1] if version is None else version:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The rows of the current version; unknown columns are dropped, missing ones null, no rows where there is no version."""
        folders = self.folders()
        if folders:
            return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])
        try:  # a plain folder of Parquet files, as other programs write it
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def _written(self, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, folders: list[str]) -> None:
        known = self.versions()
        version = known[-1] + 1 if known else 1
        beside, final = self._path(f"versions-being-written/{uuid.uuid4().hex}"), self._path(f"versions/{version:012d}")
        stream = self._system.create(beside)
        stream.write(bytearray("\n".join(folders).encode()))
        stream.close()
        self._system.mkdirs(self._path("versions"))
        if self._system.exists(final) or not self._system.rename(beside, final):
            raise RuntimeError(f"version {version} of {self.path} was published by another writer")
        for old in known[: -KEPT + 1 or None] if len(known) >= KEPT else []:
            gone = set(self.folders(old))
            self._system.delete(self._path(f"versions/{old:012d}"), False)
            for folder in gone - {f for v in self.versions() for f in self.folders(v)}:
                self._system.delete(self._path(folder), True)

    def replace(self, rows: DataFrame) -> None:
        """A version of these rows alone; they may have been read from the store."""
        self._publish([self._written(rows)])

    def append(self, rows: DataFrame) -> None:
        """A version of the earlier folders and one of these rows."""
        self._publish([*self.folders(), self._written(rows)])

    def fold(self, merge: Callable[[DataFrame], DataFrame], at: int = FOLDED_AT) -> None:
        """Rewrite a store of many folders into one, through a merge of its rows."""
        if len(self.folders()) >= at:
            self.replace(merge(self.read()))

    def vacuum(self) -> None:
        """Delete the folders that no version names; not while a writer is at work."""
        named = {f for v in self.versions() for f in self.folders(v)}
        for status in self._system.listStatus(self._path("")) if self._system.exists(self._path("")) else []:
            name = status.getPath().getName()
            if name.startswith("data-") and name not in named:
                self._system.delete(status.getPath(), True)
        self._system.delete(self._path("versions-being-written"), True)
