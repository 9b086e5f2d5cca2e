"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch


def _to_smallest(links: DataFrame, by: str, other: str, least: DataFrame) -> DataFrame:
    return links.join(least, by).select(F.col(other).alias("v"), F.col("least").alias("u")).filter("u < v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour, or to itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return _to_smallest(both.filter("v > u"), "u", "v", least).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("least"))
    moved = _to_smallest(edges.select("v", "u"), "v", "u", least)
    return moved.unionByName(least.select("v", F.col("least").alias("u"))).distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (its smallest node) for all nodes of edges u, v.  Each round is written, so lineage stays short."""
    scratch = scratch or Scratch(edges.sparkSession)
    current = scratch.keep(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct())
    state = None
    while True:
        found = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state or not found[0]:
            break
        state = found
        previous, current = current, scratch.keep(_small_star(_large_star(current)))
        scratch.drop(previous)
    roots = current.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
