"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one of our own only where it is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lumenpick-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive lost executors.

    What is left of them goes when the driver's JVM ends, whether the run succeeded or not.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/lumenpick-{uuid.uuid4().hex}"
        self.count = 0
        system, root = self._place(self.root)
        system.mkdirs(root)
        system.deleteOnExit(root)

    def _place(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found  # noqa: SLF001

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a frame once and hand back a frame that reads the written files."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a frame that no later frame reads."""
        system, path = self._place(df._scratch_path)  # noqa: SLF001
        system.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Write once and read back: cuts lineage, and lost executors cost no recomputation."""
    return Scratch(df.sparkSession).keep(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
