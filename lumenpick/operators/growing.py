"""Clusters that grow run by run: only new hashes are compared, with each other and with a kept index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HASH_THRESHOLD
from ..plans.storage import Scratch
from ..sources.generations import Store
from .cache import cache_key
from .components import components
from .similarity import INDEX_BANDS, band_index, close_pairs, pairs_with


class GrowingClusters:
    """Kept tables below a path: `hashes` (hash, id, component; one row per distinct hash) and `index` (their band keys).

    A run adds items (id, hash).  New hashes are paired among themselves and with those of the index that
    share a key with them; the edges are contracted to the components so far, and the labels that change are
    rewritten.  Ids must be larger than those of earlier runs or be known already, as scan numbers are; a
    component is its smallest id, so runs one after the other give what one run over all items gives.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: int = HASH_THRESHOLD, width: int = 64, together: int = INDEX_BANDS):
        self.spark, self.threshold, self.width, self.together = spark, threshold, width, together
        self.hashes = Store(spark, f"{path}/hashes", "hash long, id long, component long")
        self.index = Store(spark, f"{path}/index", "no int, value long, id long, hash long")

    def add(self, items: DataFrame) -> None:
        """Take up items; those without a hash stay alone and are not kept."""
        scratch = Scratch(self.spark)
        known = self.hashes.read()
        fresh = items.filter("hash is not null").groupBy("hash").agg(F.min("id").cast("long").alias("id"))
        fresh = scratch.keep(fresh.join(known.select("hash"), "hash", "left_anti"))
        if fresh.isEmpty():
            return
        among = close_pairs(fresh, self.threshold, self.width).select(F.col("a").alias("u"), F.col("b").alias("v"))
        old = known.select(F.col("id").alias("a"), F.col("component").alias("u"))
        across = pairs_with(fresh, self.index.read(), self.threshold, self.width, self.together).join(old, "a").select("u", F.col("b").alias("v"))
        labels = scratch.keep(components(scratch.keep(among.unionByName(across)), scratch))
        label = F.coalesce(F.col("label"), F.col("component"))
        all_ = known.unionByName(fresh.select("hash", "id", F.col("id").alias("component")))
        # old hashes change with their component, new ones with their own id, and either is a node
        renamed = all_.join(labels.select(F.col("node").alias("component"), F.col("component").alias("label")), "component", "left").select("hash", "id", label.alias("component"))
        # the index first: keys of hashes that the labels do not know yet are taken up again by the next run
        unindexed = band_index(fresh, self.threshold, self.width, self.together).join(self.index.read().select("id").distinct(), "id", "left_anti")
        renamed = scratch.keep(renamed)
        self.index.append(unindexed.select("no", "value", "id", "hash"))
        self.hashes.replace(renamed)

    def grouped(self, items: DataFrame) -> DataFrame:
        """Adds component to items, as `similarity.grouped` does."""
        of = self.hashes.read().select("hash", F.col("component").alias("_component"))
        return items.join(of, "hash", "left").withColumn("component", F.coalesce("_component", F.col("id").cast("long"))).drop("_component")


def with_outcomes(cache: DataFrame, items: DataFrame, path: Column | str = "path") -> DataFrame:
    """Cache rows with the cluster and the status that a run gave their images; others keep what they have."""
    place = F.col(path) if isinstance(path, str) else path
    outcome = items.select(cache_key(place).alias("cache_key"), F.col("cluster_id").alias("_cluster"), F.col("status").alias("_status")).dropDuplicates(["cache_key"])
    joined = cache.join(outcome, "cache_key", "left")
    new = {"cluster_id": F.coalesce("_cluster", "cluster_id"), "ai_status": F.coalesce("_status", "ai_status")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in cache.columns])
