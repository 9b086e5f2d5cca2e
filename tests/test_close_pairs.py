"""The blocked pair join: crowded keys, few and many hashes, narrow hashes; ranking of large clusters."""

from __future__ import annotations

import random

import pytest
from test_operators import items

from lumenpick.operators import picking, similarity


def brute(hashes, threshold):
    rows = sorted(hashes)
    return sorted((a, b, ((x ^ y) & ((1 << 64) - 1)).bit_count()) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= threshold)


@pytest.mark.parametrize(("threshold", "width", "block"), [(3, 60, 8), (8, 64, 16), (8, 60, 4096), (18, 64, 32), (18, 64, 4096), (64, 64, 64)])
def test_blocks_equal_a_plain_loop(spark, monkeypatch, threshold, width, block):
    rng = random.Random(threshold + block)
    hashes = []
    for _ in range(12):
        base = rng.getrandbits(width) & ~0xFFF
        for _ in range(20):
            h = base
            for bit in rng.sample(range(width), rng.randrange(threshold // 2 + 3) if threshold < 60 else 3):
                h ^= 1 << bit
            hashes.append(h - (1 << 64) if h >= 1 << 63 else h)
    rows = list(enumerate(dict.fromkeys(hashes)))
    df = spark.createDataFrame(rows, "id long, hash long")
    want = brute(rows, threshold)
    assert sorted(map(tuple, similarity.close_pairs(df, threshold, width, block).collect())) == want
    # as if there were so many hashes that bands pay, and a key's blocks are small
    banded = [m for m in range(1, 4) if threshold + m <= width]
    for m in banded[:2]:
        cuts = [(width * i // (threshold + m), width * (i + 1) // (threshold + m)) for i in range(threshold + m)]
        monkeypatch.setattr(similarity, "_banding", lambda t, w, n, m=m, cuts=cuts: (m, cuts) if t < 16 else None)
        assert sorted(map(tuple, similarity.close_pairs(df, threshold, width, block).collect())) == want


def test_bands_are_chosen_by_cost():
    assert similarity._banding(18, 64, 10**6) is None and similarity._banding(8, 60, 200) is None
    chosen = [similarity._banding(8, 60, 10**k) for k in (6, 8, 10)]
    assert all(chosen) and [m for m, _ in chosen] == sorted(m for m, _ in chosen)
    m, cuts = chosen[0]
    assert len(cuts) == 8 + m and cuts[0][0] == 0 and cuts[-1][1] == 60 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))


def test_large_clusters_are_ranked_like_small_ones(spark):
    rng = random.Random(1)
    rows = items(spark, *[(f"p{i}", rng.choice(["big", "big", "big", None, "c1", "c2", f"o{i % 40}"]), rng.choice([0.2, 0.5, 0.5, 0.9]), {"file_name": f"{rng.choice('aAbB')}.jpg"}) for i in range(300)]).repartition(6)
    names = ["photo_id", "cluster_id", "rank", "cluster_size", "winner"]
    whole, split = (sorted(map(str, picking.ranked(rows, large).select(names).collect())) for large in (10**6, 30))
    assert whole == split and len(whole) == 300
    assert sorted(map(str, picking.ranked(rows, 0).select(names).collect())) == whole
