"""File listings as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IMAGE_SUFFIXES, OUTPUT_FOLDERS
from ..functions.scalars import file_name, suffix
from .files import files_below, place


def is_image(path: Column) -> Column:
    return F.lower(suffix(file_name(path))).isin(*IMAGE_SUFFIXES)


def generated(path: Column) -> Column:
    """Whether any part of a path, from the root of the file system on, names a folder that an earlier run produced."""
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(f) for f in OUTPUT_FOLDERS])) | F.exists(parts, lambda p: F.endswith(F.upper(p), F.lit("_CULLED")))


def listed(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path (absolute), file_name, file_size, modified (epoch micros) of all files, names with a leading _ or . included."""
    system, top = place(root)
    if system is None and not os.path.isdir(top):
        raise FileNotFoundError(root)
    return files_below(spark, root, recursive)


def images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Image files with seq, in path order (flat scans: by lower-cased name)."""
    from ..operators.numbering import numbered

    found = listed(spark, root, recursive).filter(is_image(F.col("path")))
    if recursive:  # flat scans take generated folders too
        found = found.filter(~generated(F.col("path")))
    order = F.col("path") if recursive else F.lower("file_name")
    return numbered(found, order, F.col("path"), name="seq").withColumn("seq", (F.col("seq") - 1).cast("int"))


def folder_status(spark: SparkSession, root: str) -> str:
    """missing, empty or ok."""
    system, top = place(root)
    if system is None and not os.path.isdir(top):
        return "missing"
    return "empty" if images(spark, root).isEmpty() else "ok"


def extensions(files: DataFrame) -> DataFrame:
    return files.select(F.lower(suffix(F.col("file_name"))).alias("extension")).filter("extension <> ''").distinct().orderBy("extension")


def latest(files: DataFrame, pattern: str) -> DataFrame:
    """The newest file whose name matches a pattern; nothing if none does."""
    return files.filter(F.rlike("file_name", F.lit(pattern))).orderBy(F.desc("modified"), "path").limit(1)


def expanded(path: str | None) -> str | None:
    """A path as typed: trimmed, unquoted, home expanded; blank is None."""
    text = (path or "").strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        text = text[1:-1].strip()
    return os.path.expanduser(text) or None
