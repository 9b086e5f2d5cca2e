"""Nested score records, switches of older caches, resampling, progress per photo."""

from __future__ import annotations

import json

import numpy as np

from lumenpick.functions import pixels
from lumenpick.operators import review
from lumenpick.sources import stores
from lumenpick.streaming.progress import watched


def test_review_items_from_nested_scores(spark):
    schema = "id string, path string, status string, final_score double, face_score double, notes string, score struct<final_score: double, face_score: double, body_sharpness_score: double, reasons: array<string>, face: struct<face_score: double>, body: struct<body_blur_penalty: double>>"
    rows = [
        ("1", "/a/x.jpg", "selected", 0.1, 0.2, "n", (0.9, 0.8, 0.7, ["good", " "], (0.6,), (0.5,))), ("2", "/a/y.jpg", "odd", 0.1, 0.2, "n; m", (None, 0.8, None, [], (None,), None)),
        ("3", "/a/z.jpg", None, 0.1, 0.2, None, None),
    ]
    got = {r["photo_id"]: r for r in review.review_items(spark.createDataFrame(rows, schema)).collect()}
    pick = lambda i: (got[i]["final_score"], got[i]["face_score"], got[i]["body_sharpness"], got[i]["body_blur_penalty"], got[i]["reasons"])
    assert pick("1") == (0.9, 0.6, 0.7, 0.5, ["good"]) and pick("2") == (0.1, 0.8, 0.0, 0.0, ["n", "m"]) and pick("3") == (0.1, 0.2, 0.0, 0.0, [])
    named = spark.createDataFrame([("5", (0.25,), "a; b")], "photo_id string, scores struct<final_score: double>, reasons string")
    assert [(r["final_score"], r["reasons"]) for r in review.review_items(named).collect()] == [(0.25, ["a", "b"])]


def test_older_caches_count_under_their_switches(spark, tmp_path):
    score = {"technical": {"sharpness": 0.5, "exposure": 0.4}, "face": {"face_count": 2}, "body": {"subject_score": 0.3}, "final_score": 0.7}
    for name, record in {"a": {"score": score, "enable_body_scoring": True, "enable_person_detection": False}, "_b": {"score": score | {"reasons": ["r"]}, "enable_body_scoring": True, "enable_person_detection": True},
                         "c": {"score": score}, "d": {"enable_body_scoring": True, "enable_person_detection": False}, "e": "no record"}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "f.json").write_text("{")
    got = stores.analyses_from_files(spark, str(tmp_path)).collect()
    assert [(r["key"], r["sharpness"], r["face_count"], r["subject_score"], r["final_score"], r["duplicate_penalty"], r["reasons"]) for r in got] == [("a", 0.5, 2, 0.3, 0.7, 0.0, [])]
    assert [(r["key"], r["reasons"]) for r in stores.analyses_from_files(spark, str(tmp_path), person_detection=True).collect()] == [("_b", ["r"])]
    assert stores.analyses_from_files(spark, str(tmp_path), body_scoring=False).count() == 0 and stores.analyses_from_files(spark, str(tmp_path / "none")).count() == 0


def test_resampling_equals_the_direct_formula():
    rng = np.random.default_rng(4)

    def weight(t):
        return np.sinc(t) * np.sinc(t / 3) if abs(t) < 3 else 0.0

    def line(values, parts):
        scale, out = len(values) / parts, []
        for i in range(parts):
            w = [weight((k + 0.5 - (i + 0.5) * scale) / max(1, scale)) for k in range(len(values))]
            out.append(min(255, max(0, int(np.floor(sum(a * b for a, b in zip(w, values, strict=True)) / sum(w) + 0.5)))))
        return out

    for rows, cols, to in ((40, 51, 32), (7, 90, 11), (5, 5, 5)):
        image = rng.integers(0, 256, (rows, cols)).astype(np.uint8)
        first = np.array([line(r, to) for r in image.astype(float)])
        want = np.array([line(c, to) for c in first.T.astype(float)]).T
        assert (pixels.resampled(image, to, to) == want).all()
    assert (pixels.resampled(np.full((50, 70), 9, np.uint8), 32, 32) == 9).all()


def test_hashes_are_steady_under_rescaling():
    rng = np.random.default_rng(6)
    for _ in range(10):
        y, x = np.mgrid[0:240, 0:320] / 40
        image = np.zeros((240, 320))
        for _ in range(6):
            a, b, c = rng.normal(size=3)
            image += np.sin(a * x * 2 + b * y * 2 + 3 * c)
        image = np.clip(128 + 40 * image, 0, 255).astype(np.uint8)
        h = int(pixels.perceptual_hash(image), 16)
        for rows, cols in ((120, 160), (300, 400), (97, 131)):
            assert (h ^ int(pixels.perceptual_hash(pixels.resampled(image, rows, cols)), 16)).bit_count() <= 4
        assert (h ^ int(pixels.perceptual_hash(image[:, ::-1]), 16)).bit_count() > 8


def test_one_event_per_photo(spark):
    rows, seen = spark.range(0, 90, 1, 6).selectExpr("concat('p', id, '.jpg') AS file_name", "id"), []
    with watched(rows, "file_name", 90, seen.append) as told:
        assert sorted(told.collect()) == sorted(rows.collect())
    assert [p.current for p in seen] == list(range(1, 91)) and {p.total for p in seen} == {90} and len({p.message.split(" ")[0] for p in seen}) == 90
    with watched(rows, "file_name", 90, seen.append) as told:
        assert told.count() == 90


def test_crowded_names_are_numbered_like_others(spark):
    import random

    from lumenpick.operators import export

    rng = random.Random(3)
    rows = [(rng.choice("fg"), rng.choice(["a.jpg", "a.jpg", "a.jpg", "a_1.jpg", "a_2.jpg", "b", "a_7.jpg"]), i) for i in range(150)]
    there = [("f", "a.jpg"), ("f", "a_3.jpg"), ("g", "a_1.jpg"), ("g", "b"), ("g", "b_2")]
    df = spark.createDataFrame(rows, "folder string, file_name string, seq int").repartition(5)
    existing = spark.createDataFrame(there, "folder string, file_name string")
    small, split = (sorted(map(tuple, export.collision_free(df, existing=existing, large=n).collect())) for n in (10**6, 20))
    assert small == split and len({(f, d) for f, _, _, d in small} | set(there)) == 150 + len(there)
    taken = set(there)
    for folder in "fg":  # every row has the first free number of its name
        for name in {n for f, n, _ in rows if f == folder}:
            stem, dot, ending = name.partition(".")
            used = {d for f, n, _, d in small if f == folder and n != name} | {n for f, n in taken if f == folder} | {n for f, n, _ in rows if f == folder and n != name}
            free = [x for x in [name, *[f"{stem}_{k}{dot}{ending}" for k in range(1, 400)]] if x not in used or (x == name and (folder, name) not in taken)]
            got = [d for f, n, _, d in sorted(small, key=lambda r: r[2]) if f == folder and n == name]
            assert [x for x in got if x not in used] == got and got == [x for x in free if x in got]


def test_invalidated_paths_leave_the_cache(spark):
    from pyspark.sql import functions as F

    from lumenpick.operators import cache

    rows = spark.createDataFrame([("/A/x.jpg", 1), ("/a/y.jpg", 2), ("/a/z.jpg", 3)], "path string, n int").withColumn("cache_key", cache.cache_key(F.col("path")))
    gone = spark.createDataFrame([("/a/X.jpg",), ("/a/X.jpg",), ("/none",)], "path string")
    assert sorted(r["n"] for r in cache.invalidated(rows, gone).collect()) == [2, 3]
    assert cache.invalidated(rows, gone.limit(0)).count() == 3


def test_labels_follow_their_pattern_and_rows_their_scan_order(spark):
    from lumenpick.operators import similarity

    rows = spark.createDataFrame([(3, 3, "b.jpg", 3), (1, 1, "c.jpg", 1), (2, 1, "A.jpg", 2), (4, 4, "a.jpg", 0)], "id long, component long, name string, seq long").repartition(3)
    got = similarity.labelled(rows, "group-%d").orderBy("seq").collect()
    assert [(r["id"], r["cluster_id"], r["cluster_size"], r["confidence"]) for r in got] == [(4, "group-1", 1, 0.0), (1, "group-2", 2, 1.0), (2, "group-2", 2, 1.0), (3, "group-3", 1, 0.0)]
    assert [r["cluster_id"] for r in similarity.ungrouped(rows, "G%02d").orderBy("seq").collect()] == ["G01", "G02", "G03", "G04"]


def test_first_generation_reports_are_written(spark, tmp_path):
    from test_operators import items

    from lumenpick.operators import picking, reports

    done = picking.picked(items(spark, ("a", "1", 0.9, {}), ("b", "1", 0.4, {}))).withColumn("reasons", picking.reasons("balanced"))
    target = reports.single_csv(reports.first_rows(done).orderBy("filename"), str(tmp_path / "first.csv"))
    lines = open(target, encoding="utf-8-sig").read().splitlines()
    assert lines[0].split(",") == reports.FIRST_COLUMNS and [x.split(",")[0] for x in lines[1:]] == ["a.jpg", "b.jpg"]
