"""Nearest neighbours: what the driver holds, and cells of groups and slices against brute force."""

from __future__ import annotations

import tracemalloc

import numpy as np

from lumenpick.llm import vector_search

import brute
from test_training_operators import rows


def test_the_driver_holds_a_block_of_distances(spark):
    rng = np.random.default_rng(1)
    x, centers = rng.normal(size=(8 * vector_search.FIT_ROWS, 8)), rng.normal(size=(vector_search.MAX_LISTS, 8))
    tracemalloc.start()
    got = vector_search._nearest(x, centers)  # noqa: SLF001
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * vector_search.FIT_ROWS * len(centers) * 8  # three of all rows before
    assert (got[:50] == [np.argmin(((centers - v) ** 2).sum(axis=1)) for v in x[:50]]).all()


def test_tasks_send_the_driver_few_candidates_for_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "TRAIN_ROWS", 100)
    classes = spark.range(20_000).selectExpr("id as class", "cast(cast(id as string) as binary) as vector")
    sample = vector_search._sample(classes, 20_000)  # noqa: SLF001
    taken = sorted(bytes(r["vector"]) for r in sample.collect())
    whole = sorted(bytes(r["vector"]) for r in classes.selectExpr("vector", "xxhash64(class) as h").orderBy("h").limit(100).collect())
    assert taken == whole and "Filter (xxhash64(" in sample._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001


def test_cells_find_what_brute_force_finds(spark, monkeypatch):
    """Many groups and slices, lists split over groups, and a vector in so many rows that it is dealt in parts."""
    monkeypatch.setattr(vector_search, "CELL_BYTES", 2048)
    rng = np.random.default_rng(5)
    near = [(i, (rng.normal(size=8) * 0.05 + 1).tolist()) for i in range(1, 600)]
    far = [(i, rng.normal(size=8).tolist()) for i in range(600, 1200)]
    copies = [(i, [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0]) for i in range(2000, 2400)]
    df = spark.createDataFrame(near + far + copies + copies[:50], "vec_id long, embedding array<float>").repartition(5)
    got = rows(vector_search.nearest_neighbours(df, probe_share=1.0), "query_id", "rank", "vec_id", "score")
    want = brute.neighbours([(i, np.array(v, np.float32).tolist()) for i, v in near + far + copies])
    assert got == want
