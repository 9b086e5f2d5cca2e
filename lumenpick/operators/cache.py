"""Reuse of earlier analyses: keys, validity, hits and misses, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Preset


def photo_id(path: Column, size: Column, modified_micros: Column) -> Column:
    return F.sha1(F.concat_ws("|", path, size.cast("string"), modified_micros.cast("string")))


def cache_key(path: Column) -> Column:
    return F.sha1(F.lower(path))


def versioned_key(path: Column, preset: Preset) -> Column:
    """A key that also changes with mode, size, versions and the parts of the analysis that are on."""
    parts = (preset.mode, preset.max_analysis_size, preset.cache_version, preset.scoring_version, preset.face_analysis, preset.body_analysis)
    return F.sha1(F.concat_ws("|", F.lower(path), *[F.lit(str(p)) for p in parts]))


def valid(file: str, cached: str, preset: Preset) -> Column:
    """Whether a cached row still describes the file: path, size, time, mode and versions agree."""
    f, c = (lambda n: F.col(f"{file}.{n}")), (lambda n: F.col(f"{cached}.{n}"))
    return (
        f("path").eqNullSafe(c("path")) & f("file_size").eqNullSafe(c("file_size")) & f("modified").eqNullSafe(c("modified")) & (c("analysis_mode") == preset.mode)
        & (c("analysis_size") == preset.max_analysis_size) & (c("cache_version") == preset.cache_version) & (c("scoring_version") == preset.scoring_version)
    )


def looked_up(files: DataFrame, cache: DataFrame, preset: Preset, force: bool = False) -> DataFrame:
    """files with cache_hit and `cached` (the cache row, null on a miss)."""
    f = files.withColumn("_key", cache_key(F.col("path"))).alias("f")
    if force:
        return files.withColumn("cache_hit", F.lit(False)).withColumn("cached", F.lit(None).cast(cache.schema.simpleString()))
    c = cache.alias("c")
    joined = f.join(c, (F.col("f._key") == F.col("c.cache_key")) & valid("f", "c", preset), "left")
    hit = F.col("c.cache_key").isNotNull()
    return joined.select(*[F.col(f"f.{n}") for n in files.columns], hit.alias("cache_hit"), F.when(hit, F.struct("c.*")).alias("cached"))


def hits(files: DataFrame, cache: DataFrame, preset: Preset) -> DataFrame:
    return looked_up(files, cache, preset).filter("cache_hit")


def misses(files: DataFrame, cache: DataFrame, preset: Preset) -> DataFrame:
    """Files to analyse: those without a valid cache row."""
    f, c = files.withColumn("_key", cache_key(F.col("path"))).alias("f"), cache.alias("c")
    return f.join(c, (F.col("f._key") == F.col("c.cache_key")) & valid("f", "c", preset), "left_anti").drop("_key")


def merged(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache after a run.  Failed analyses are not kept, so they are tried again."""
    good = fresh.filter("analysis_error is null") if "analysis_error" in fresh.columns else fresh
    return cache.join(good.select("cache_key").distinct(), "cache_key", "left_anti").unionByName(good, allowMissingColumns=True)


def invalidated(cache: DataFrame, paths: DataFrame) -> DataFrame:
    return cache.join(paths.select(cache_key(F.col("path")).alias("cache_key")).distinct(), "cache_key", "left_anti")
