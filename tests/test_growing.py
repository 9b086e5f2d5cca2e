"""Runs one after the other give the clusters of one run over all, and their outcomes reach the cache."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenpick.operators import similarity
from lumenpick.operators.cache import cache_key
from lumenpick.operators.growing import GrowingClusters, with_outcomes
from lumenpick.sources.generations import Store


def photos(n, seed=1):
    """(id, hash): chains of near hashes, copies, hashes that later ones connect, and none."""
    rng, out = random.Random(seed), []
    bases = [rng.getrandbits(60) for _ in range(n // 12)]
    for i in range(n):
        if i % 17 == 0:
            out.append((i, None))
            continue
        h = rng.choice(bases)
        for bit in rng.sample(range(60), rng.choice([0, 2, 5, 7, 9, 14])):
            h ^= 1 << bit
        out.append((i, h))
        if rng.random() < 0.3:
            bases.append(h)
    return out


@pytest.mark.parametrize("cuts", [(0, 240), (0, 100, 240), (0, 1, 90, 91, 200, 200, 240)])
def test_runs_equal_one_run(spark, tmp_path, cuts):
    rows = photos(240)
    frame = lambda some: spark.createDataFrame(some, "id long, hash long")
    clusters = GrowingClusters(spark, str(tmp_path / "clusters"), threshold=8, width=60)
    for low, high in zip(cuts, cuts[1:], strict=False):
        clusters.add(frame(rows[low:high] + rows[: low // 2]))  # known ones come again
    got = {r["id"]: r["component"] for r in clusters.grouped(frame(rows)).collect()}
    want = {r["id"]: r["component"] for r in similarity.grouped(frame(rows), 8, 60).collect()}
    assert got == want and 10 < len(set(want.values())) < 240
    assert clusters.index.read().count() == clusters.hashes.read().count() * 45


def test_pairs_with_an_index(spark):
    rows = [(i, h) for i, h in photos(300, 7) if h is not None]
    rows = list({h: (i, h) for i, h in rows}.values())
    old, new = rows[:170], rows[170:]
    frame = lambda some: spark.createDataFrame(some, "id long, hash long")
    want = sorted((a, b, (x ^ y).bit_count()) for a, x in old for b, y in new if (x ^ y).bit_count() <= 8)
    for block in (4096, 2):
        got = similarity.pairs_with(frame(new), similarity.band_index(frame(old), 8, 60), 8, 60, block=block)
        assert sorted(map(tuple, got.collect())) == want and want


def test_a_run_that_dies_is_made_up_for(spark, tmp_path, monkeypatch):
    rows = photos(200, 3)
    frame = lambda some: spark.createDataFrame(some, "id long, hash long")
    clusters = GrowingClusters(spark, str(tmp_path / "clusters"), 8, 60)
    clusters.add(frame(rows[:120]))
    with monkeypatch.context() as m:
        m.setattr(Store, "replace", lambda self, rows: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            clusters.add(frame(rows[120:]))
    clusters.add(frame(rows[120:]))
    got = {r["id"]: r["component"] for r in clusters.grouped(frame(rows)).collect()}
    assert got == {r["id"]: r["component"] for r in similarity.grouped(frame(rows), 8, 60).collect()}


def test_outcomes_reach_the_cache(spark):
    cache = spark.createDataFrame([("/A.jpg", None, None, 0.5), ("/b.jpg", "CL1", "review", 0.6)], "path string, cluster_id string, ai_status string, final_score double").withColumn("cache_key", cache_key(F.col("path")))
    items = spark.createDataFrame([("/a.jpg", "CL7", "selected"), ("/none.jpg", "CL9", "review")], "path string, cluster_id string, status string")
    got = {r["path"]: (r["cluster_id"], r["ai_status"], r["final_score"]) for r in with_outcomes(cache, items).collect()}
    assert got == {"/A.jpg": ("CL7", "selected", 0.5), "/b.jpg": ("CL1", "review", 0.6)}
