"""The given tables read as images, items, decisions and files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import num, rounded
from ..operators import images
from ..operators.scoring import final_score
from .storage import table

#: Face boxes of every tile.
FACE_BOXES = [(8, 6, 10, 10), (18, 4, 8, 8)]

#: A hand-made cascade of windows of 4 by 4: the inner square brighter than the whole, then the upper half at least as bright as the lower.
CASCADE = json.dumps({"width": 4, "height": 4, "stages": [
    {"threshold": 0.5, "stumps": [{"rects": [[1, 1, 2, 2, 1.0], [0, 0, 4, 4, -1.0]], "threshold": 0.5, "left": 0.0, "right": 1.0}]},
    {"threshold": 0.5, "stumps": [{"rects": [[0, 0, 4, 2, 1.0], [0, 2, 4, 2, -1.0]], "threshold": 0.0, "left": 0.0, "right": 1.0}]},
]})


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.tiles(table(spark, sf_dir, "embeddings"))


def scored_tiles(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Tiles as items without faces: technical and body scores in one pass, clustered by label."""
    c = F.col
    both = images.with_technical_and_body(tiles(spark, sf_dir))
    faceless = both.withColumns(images.neutral_face())
    score = final_score(c("sharpness"), c("exposure"), c("contrast"), c("global_blur_penalty"), c("face_score"), c("body_sharpness"), c("body_blur_penalty"), c("subject_score"), mode)
    return faceless.withColumns({"photo_id": c("vec_id").cast("string"), "file_name": F.concat(c("vec_id").cast("string"), F.lit(".jpg")), "seq": c("vec_id"), "cluster_id": c("label").cast("string"), "final_score": score})


def line_items(spark: SparkSession, sf_dir: str, mode: str = "balanced", dealt: bool = False) -> DataFrame:
    """Order lines as items: an order is a cluster, quantities and prices give the scores; dealt: with the lines of a cluster in one partition."""
    c = F.col
    lines, cluster = table(spark, sf_dir, "lineitem"), F.concat(F.lit("O"), c("l_orderkey").cast("string"))
    lines = lines.repartition(cluster) if dealt else lines
    detected = c("l_linenumber") % 2 == 0
    body = (F.floor("l_extendedprice") % 100) / num(100)
    items = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(c("l_extendedprice") * num(100) + num(0.5)).cast("string"), F.date_format("l_shipdate", "yyyyMMdd")).alias("photo_id"),
        F.concat(F.lit("/photos/"), c("l_orderkey").cast("string"), F.lit("/IMG_"), c("l_partkey").cast("string"), F.lit(".jpg")).alias("path"),
        F.concat(F.lit("IMG_"), c("l_partkey").cast("string"), F.lit(".jpg")).alias("file_name"), cluster.alias("cluster_id"),
        rounded(c("l_quantity") / num(50)).alias("sharpness"), rounded(c("l_discount") * num(10)).alias("exposure"), rounded(c("l_tax") * num(12.5)).alias("contrast"),
        rounded(num(1) - c("l_quantity") / num(50)).alias("global_blur_penalty"), detected.alias("face_detected"), F.when(detected, 1 + c("l_partkey") % 4).otherwise(0).cast("int").alias("face_count"),
        F.when(detected, (c("l_partkey") % 100) / num(100)).otherwise(num(0)).alias("face_sharpness"), F.when(detected, (c("l_suppkey") % 100) / num(100)).otherwise(num(0.45)).alias("face_score"),
        F.lit(True).alias("person_detected"), body.alias("body_sharpness"), rounded(num(1) - body).alias("body_blur_penalty"), body.alias("subject_score"),
    ).withColumn("seq", c("photo_id"))
    return items.withColumn(
        "final_score", final_score(c("sharpness"), c("exposure"), c("contrast"), c("global_blur_penalty"), c("face_score"), c("body_sharpness"), c("body_blur_penalty"), c("subject_score"), mode)
    )


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clicks of a reviewer: a user stands for a photo."""
    kind = F.col("event_type")
    final = F.when(kind == "click", "post").when(kind == "view", "save").when(kind == "error", "delete").otherwise("undecided")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("photo_id"), F.col("ts").alias("decision_updated_at"), "event_id", final.alias("final_decision"), F.lit("user").alias("decision_source"), F.coalesce("props", F.lit("")).alias("notes")
    )


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reviewed items, by market segment and balance."""
    c = F.col
    segment = c("c_mktsegment")
    status = F.when(segment == "BUILDING", "KEEP").when(segment == "MACHINERY", "reject").when(segment == "AUTOMOBILE", " Selected ").when(segment == "HOUSEHOLD", F.lit(None)).otherwise("unsure")
    return table(spark, sf_dir, "customer").select(
        c("c_custkey").cast("string").alias("photo_id"), F.concat(c("c_name"), F.lit(".jpg")).alias("filename"), F.concat(F.lit("/photos/"), c("c_name"), F.lit(".jpg")).alias("original_path"),
        status.alias("output_status"), F.concat(F.lit("CL"), c("c_nationkey").cast("string")).alias("cluster_id"), (c("c_custkey") % 7 == 0).alias("is_cluster_winner"),
        c("c_acctbal").cast("string").alias("final_score"), F.concat(segment, F.lit("; ;"), c("c_name")).alias("final_reason"),
    )


def mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as result rows in which both namings occur and some of either are blank."""
    k, name = F.col("c_custkey"), F.col("c_name")
    some = lambda n, value, blank="": F.when(k % n == 0, F.lit(blank)).otherwise(value)
    return table(spark, sf_dir, "customer").select(
        some(2, k.cast("string")).alias("id"), some(3, F.concat(F.lit("p"), k.cast("string"))).alias("photo_id"), some(5, F.concat(F.lit("/a/"), name, F.lit(".jpg")), None).alias("path"),
        some(7, F.concat(name, F.lit(".JPG"))).alias("filename"), some(2, F.lit("keep"), None).alias("status"), F.lit("REJECTED").alias("output_status"),
        some(3, F.concat(F.lit("CL"), F.col("c_nationkey").cast("string"))).alias("cluster_id"), F.lit("G1").alias("duplicate_group_id"),
        (k % 4 == 0).alias("is_cluster_winner"), (k % 6 == 0).alias("is_best_duplicate"), some(5, F.col("c_acctbal").cast("string"), "n/a").alias("score_percent"), k.cast("double").alias("final_score"),
        some(3, F.lit("one; two")).alias("reasons"), F.lit("note;;").alias("notes"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files below a photo folder, some of them in folders of earlier runs."""
    c = F.col
    ending = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".gif", ".txt")]), (c("page_id") % 5 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in ("trip", "01_SELECTED", "x_CULLED", "home/album")]), (F.floor(c("page_id") / 5) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(folder, F.lit("/"), c("page_id").cast("string"), ending).alias("path"), F.length("html").cast("long").alias("file_size"))


def cached_and_current(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as files, and a cache of them in which some sizes, times, modes and versions no longer agree."""
    c = F.col
    base = table(spark, sf_dir, "events").select(
        F.concat(F.lit("/photos/e"), c("event_id").cast("string"), F.lit(".jpg")).alias("path"), (F.floor(c("value") * num(100))).cast("long").alias("file_size"), F.unix_micros(F.col("ts").cast("timestamp")).alias("modified"), "event_id"
    )
    n = c("event_id")
    cache = base.filter(n % 3 != 0).select(
        F.sha1(F.lower("path")).alias("cache_key"), "path", (c("file_size") + F.when(n % 5 == 0, 1).otherwise(0)).alias("file_size"), (c("modified") + F.when(n % 7 == 0, 10_000_000).otherwise(0)).alias("modified"),
        F.when(n % 11 == 0, "fast").otherwise("balanced").alias("analysis_mode"), F.when(n % 13 == 0, 1024).otherwise(1600).alias("analysis_size"), F.lit("1").alias("cache_version"), F.when(n % 17 == 0, "0").otherwise("1").alias("scoring_version"),
    )
    return base.drop("event_id"), cache
