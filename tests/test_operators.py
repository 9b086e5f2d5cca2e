from __future__ import annotations

import json
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenpick.config import preset, resolve_workers, score_mode
from lumenpick.functions import pixels, scalars as s
from lumenpick.operators import cache, export, images, picking, reports, review, scoring, similarity
from lumenpick.operators.components import components
from lumenpick.sources import listing, photos, stores
from lumenpick.sources.generations import Store
from lumenpick.streaming.incremental import keyed_upserts, latest_upserts, windowed_progress

ITEM = dict(path="/p", sharpness=0.8, exposure=0.8, contrast=0.7, global_blur_penalty=0.1, face_detected=True, face_count=1, face_sharpness=0.8, face_score=0.8,
            person_detected=True, body_sharpness=0.8, body_blur_penalty=0.1, subject_score=0.8)


def items(spark, *rows):
    return spark.createDataFrame([ITEM | dict(photo_id=n, file_name=f"{n}.jpg", cluster_id=c, final_score=v, seq=i) | more for i, (n, c, v, more) in enumerate(rows)])


def statuses(df):
    return {r["photo_id"]: r["status"] for r in df.collect()}


def png(path, pixels):
    """An 8-bit gray image."""
    height, width = len(pixels), len(pixels[0])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_the_best_of_a_cluster_wins(spark):
    three = items(spark, ("a", "1", 0.6, {}), ("b", "1", 0.9, {}), ("c", "1", 0.3, {}))
    assert statuses(picking.picked(three, "aggressive")) == {"a": "rejected", "b": "selected", "c": "rejected"}
    close = items(spark, ("a", "1", 0.90, {}), ("b", "1", 0.86, {}), ("c", "1", 0.65, {}))
    assert statuses(picking.simply_picked(close, "conservative")) == {"a": "selected", "b": "selected", "c": "rejected"}
    assert statuses(picking.picked(close, "balanced")) == {"a": "selected", "b": "review", "c": "review"}


def test_ties_go_by_name(spark):
    same = items(spark, ("B", "1", 0.9, {}), ("a", "1", 0.9, {}))
    assert {r["photo_id"]: r["rank"] for r in picking.ranked(same).collect()} == {"a": 1, "B": 2}


def test_reasons_name_winner_and_gaps(spark):
    two = items(spark, ("w", "1", 0.9, {}), ("l", "1", 0.7, dict(body_blur_penalty=0.7)), ("u", "2", 0.2, dict(face_detected=False)))
    out = {r["photo_id"]: r["reasons"] for r in picking.picked(two).withColumn("reasons", picking.reasons("balanced")).collect()}
    assert out["w"][0] == "Selected as best image in similar cluster."
    assert out["l"][:2] == ["Similar to w.jpg; final score lower by 0.20.", "Body blur penalty higher than winner by 0.60."]
    assert "Large score gap from selected winner." in out["l"]
    assert out["u"][0].startswith("Unique image") and "No face detected." in out["u"]


def test_typed_reasons(spark):
    df = spark.createDataFrame([("selected", ["x"]), ("review", ["x"]), ("rejected", ["x"])], "status string, reasons array<string>")
    got = [[(t["type"], t["code"]) for t in r[0]] for r in df.select(picking.typed_reasons(F.col("status"), F.col("reasons"))).collect()]
    assert got == [[("positive", "SELECTED_REASON")], [], [("negative", "REJECTED_REASON")]]


def test_banded_pairs_equal_compared_pairs(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    hashes = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 12))) for b in base]
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(signed, "id long, hash long")
    for t in (0, 3, 8):
        assert sorted(similarity.close_pairs(df, t).collect()) == sorted(similarity.compared_pairs(df, t).collect())


@pytest.mark.parametrize("threshold, old_width", [(8, 8), (18, 4)])
def test_pairs_differing_in_every_old_band_are_found(spark, threshold, old_width):
    spread = sum(1 << b for b in range(0, 64, old_width))
    df = spark.createDataFrame([("a", 0), ("b", spread - (1 << 64) if spread >> 63 else spread), ("c", -1)], "id string, hash long")
    assert [tuple(r) for r in similarity.close_pairs(df, threshold).collect()] == [("a", "b", 64 // old_width)]


def test_a_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(chain).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100
    assert components(chain.limit(0)).count() == 0


def test_clusters_are_numbered_by_name(spark):
    df = spark.createDataFrame([(1, 5, "z.jpg", 0), (2, 5, "z.jpg", 1), (3, 9, "A.jpg", 2), (4, None, "m.jpg", 3)], "id long, hash long, name string, seq long")
    got = {r["id"]: (r["cluster_id"], r["cluster_size"], r["confidence"]) for r in similarity.labelled(similarity.grouped(df, 0)).collect()}
    assert got == {3: ("CL0001", 1, 0.0), 4: ("CL0002", 1, 0.0), 1: ("CL0003", 2, 1.0), 2: ("CL0003", 2, 1.0)}


def test_names_never_collide(spark):
    names = ["a.jpg", "a.jpg", "a_1.jpg", "a.jpg", "b", "b", ".env", ".env"]
    df = spark.createDataFrame([("f", n, i) for i, n in enumerate(names)], "folder string, file_name string, seq long")
    got = [r["destination_name"] for r in export.collision_free(df).orderBy("seq").collect()]
    assert len(set(got)) == len(got) and got == ["a.jpg", "a_2.jpg", "a_1.jpg", "a_3.jpg", "b", "b_1", ".env", ".env_1"]


def test_copies_and_missing_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"1")
    plan = spark.createDataFrame([(str(tmp_path / "a.jpg"), str(tmp_path / "out/a.jpg")), (str(tmp_path / "no.jpg"), str(tmp_path / "out/no.jpg"))], "source string, destination string")
    errors = {r["source"]: r["error"] for r in export.run_copies(plan).collect()}
    assert errors[str(tmp_path / "a.jpg")] is None and errors[str(tmp_path / "no.jpg")]
    assert (tmp_path / "out/a.jpg").read_bytes() == b"1"


def test_review_items_progress_and_filters(spark):
    rows = spark.createDataFrame([("1", "a.jpg", "keep", "0.5", "x; ;y"), ("2", "b.jpg", None, "bad", None), ("3", "c.jpg", "reject", "70", "z")], "photo_id string, filename string, output_status string, final_score string, final_reason string")
    decided = review.with_decisions(review.review_items(rows), spark.createDataFrame([("1", "SAVE"), ("9", "post")], "photo_id string, final_decision string"))
    got = {r["photo_id"]: (r["ai_status"], r["final_decision"], r["final_score"], r["reasons"]) for r in decided.collect()}
    assert got == {"1": ("selected", "save", 0.5, ["x", "y"]), "2": ("review", "undecided", 0.0, []), "3": ("rejected", "undecided", 70.0, ["z"])}
    assert review.progress(decided).first().asDict() == dict(total=3, post=0, save=1, delete=0, undecided=2, ai_selected=1, ai_review=1, ai_rejected=1)
    assert review.in_bucket(decided, "final_decision", "nonsense").count() == 2


def test_upserts(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "photo_id string, v string")
    new = spark.createDataFrame([("2", "c"), ("3", "d")], "photo_id string, v string")
    assert sorted(map(tuple, review.upserted(old, new).collect())) == [("1", "a"), ("2", "c"), ("3", "d")]
    assert [r["photo_id"] for r in review.without(old, new).collect()] == ["1"]


def test_ring_wraps(spark):
    df = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "g string, n long")
    assert sorted(map(tuple, review.ring(df, ["g"], ["n"], "n").collect())) == [("s", 1, 2, 3), ("s", 2, 3, 1), ("s", 3, 1, 2)]


@pytest.mark.parametrize("change, hit", [({}, True), ({"file_size": 11}, False), ({"modified": 15}, False), ({"analysis_mode": "fast"}, False), ({"analysis_size": 1024}, False), ({"cache_version": "2"}, False)])
def test_cache_validity(spark, change, hit):
    row = dict(path="/p/A.jpg", file_size=10, modified=5, analysis_mode="balanced", analysis_size=1600, cache_version="1", scoring_version="1")
    stored = spark.createDataFrame([row | change]).withColumn("cache_key", cache.cache_key(F.col("path")))
    files = spark.createDataFrame([("/p/A.jpg", 10, 5)], "path string, file_size long, modified long")
    assert cache.looked_up(files, stored, preset("balanced")).first()["cache_hit"] is hit
    assert cache.misses(files, stored, preset("balanced")).count() == (0 if hit else 1)
    assert cache.looked_up(files, stored, preset("balanced"), force=True).first()["cache_hit"] is False


def test_failed_analyses_are_not_cached(spark):
    old = spark.createDataFrame([("k", None)], "cache_key string, analysis_error string")
    new = spark.createDataFrame([("k", "broken"), ("n", None)], "cache_key string, analysis_error string")
    assert sorted(r["cache_key"] for r in cache.merged(old, new).collect()) == ["k", "n"]


def test_summaries_of_nothing_are_zero(spark):
    empty = picking.picked(items(spark, ("a", "1", 0.5, {}))).withColumn("reasons", picking.reasons("balanced")).limit(0)
    assert set(reports.run_summary(reports.flat_rows(empty)).first()) == {0}
    assert reports.engine_summary(empty).first()["average_final_score"] == 0.0


def test_report_columns_and_files(spark, tmp_path):
    one = picking.picked(items(spark, ("a", "1", 0.5, {}))).withColumn("reasons", picking.reasons("balanced"))
    assert reports.audit_rows(one).columns == reports.AUDIT_COLUMNS and len(reports.AUDIT_COLUMNS) == 34
    assert len(reports.FLAT_COLUMNS) == 43 and len(reports.FIRST_COLUMNS) == 31 and len(reports.DECISION_COLUMNS) == 15
    target = reports.single_csv(reports.flat_rows(one), str(tmp_path / "r.csv"))
    assert open(target, "rb").read(3) == b"\xef\xbb\xbf"
    assert spark.read.json(reports.write_json(reports.audit_json(one), str(tmp_path))).select("scoreBreakdown.finalScore").first()[0] == 0.5


def test_listing_keeps_odd_names_and_skips_outputs(spark, tmp_path):
    for name in ("_DSC1.JPG", "b.png", "note.txt", "sub/c.jpeg", "01_SELECTED/d.jpg", "trip_culled/e.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["file_name"] for r in listing.images(spark, str(tmp_path)).orderBy("seq").collect()] == ["_DSC1.JPG", "b.png", "c.jpeg"]
    assert listing.folder_status(spark, str(tmp_path / "none")) == "missing" and listing.folder_status(spark, str(tmp_path)) == "ok"
    assert [r[0] for r in listing.extensions(listing.listed(spark, str(tmp_path))).collect()] == [".jpeg", ".jpg", ".png", ".txt"]


def test_images_are_analysed_and_broken_ones_reported(spark, tmp_path):
    png(tmp_path / "lines.png", [[255 if x % 6 == 0 else 0 for x in range(96)] for _ in range(96)])
    png(tmp_path / "flat.png", [[80] * 96 for _ in range(96)])
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.analysed(photos.decoded(spark, str(tmp_path)), preset("balanced")).collect()}
    assert got["lines.png"]["sharpness"] > got["flat.png"]["sharpness"] and len(got["flat.png"]["phash"]) == 16
    assert got["broken.png"]["analysis_error"] and got["broken.png"]["final_score"] == 0.0
    fast = images.analysed(photos.decoded(spark, str(tmp_path)), preset("fast")).filter("analysis_error is null").first()
    assert fast["subject_score"] == 0.45 and fast["person_detected"] is False


def test_a_failing_detector_finds_nothing():
    assert images.safely_detected(lambda image: 1 / 0, None) == []
    assert images.safely_detected(lambda image: [(1, 2, 3, 4, 0.9)], None) == [(1, 2, 3, 4)]


def test_exif():
    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value
    make, model = b"Maker\0", b"Cam\0"
    head = b"II*\0" + struct.pack("<I", 8)
    body = struct.pack("<H", 3) + entry(0x010F, 2, len(make), struct.pack("<I", 100)) + entry(0x0110, 2, len(model), model) + entry(0x8769, 4, 1, struct.pack("<I", 60)) + struct.pack("<I", 0)
    tiff = (head + body).ljust(60, b"\0") + struct.pack("<H", 2) + entry(0x8827, 3, 1, struct.pack("<HH", 200, 0)) + entry(0x829D, 5, 1, struct.pack("<I", 110)) + struct.pack("<I", 0)
    tiff = tiff.ljust(100, b"\0") + make.ljust(10, b"\0") + struct.pack("<II", 28, 10)
    got = photos.exif(b"\xff\xd8\xff\xe1xxExif\0\0" + tiff)
    assert (got["camera"], got["iso"], got["aperture"], got["lens"]) == ("Maker Cam", 200, "28/10", None)
    assert set(photos.exif(b"nothing").values()) == {None}


def test_decision_store(spark, tmp_path):
    path = tmp_path / "d.json"
    assert stores.decisions_from_json(spark, str(path)).count() == 0
    path.write_text('{"k": {"photo_id": "", "final_decision": "POST"}, "j": {"photo_id": "p", "final_decision": "?"}}')
    assert sorted((r["photo_id"], r["final_decision"]) for r in stores.decisions_from_json(spark, str(path)).collect()) == [("k", "post"), ("p", "undecided")]
    path.write_text("[1]")
    assert stores.decisions_from_json(spark, str(path)).count() == 0


def test_streams(spark, tmp_path):
    schema = "photo_id string, at long, final_decision string"
    log = str(tmp_path / "log")
    run = lambda: keyed_upserts(spark.readStream.schema(schema).parquet(log), str(tmp_path / "store"), schema, "photo_id", ("at",), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("1", 1, "save"), ("1", 3, "post"), ("2", 1, "save")], schema).write.parquet(log)
    run()
    spark.createDataFrame([("1", 2, "delete"), ("2", 5, "delete")], schema).write.mode("append").parquet(log)
    run()
    newest = latest_upserts(Store(spark, str(tmp_path / "store"), schema), "photo_id", ("at",))
    assert sorted(map(tuple, newest.select("photo_id", "final_decision").collect())) == [("1", "post"), ("2", "delete")]
    assert windowed_progress(spark.readStream.schema("ts timestamp, final_decision string").parquet(log)).isStreaming


def test_small_expressions(spark):
    row = spark.range(1).select(
        s.two_decimals(F.lit(0.125)), s.percent_label(F.lit(0.5)), s.percent_label(F.lit(55.0)), s.stem(F.lit("a.b.jpg")), s.stem(F.lit(".env")), s.suffix(F.lit(".env")),
        s.user_path(F.lit(" '/x y' ")), s.user_path(F.lit("  ")), s.first_number(F.lit("x"), F.lit("2.5")), s.unsigned_hex(F.lit("ffffffffffffffff")), s.hamming(F.lit(-1), F.lit(0)),
    ).first()
    assert list(row) == ["0.13", "50.0%", "55.0%", "a.b", ".env", "", "/x y", None, 2.5, -1, 64]


def test_presets():
    assert preset("fast").max_analysis_size == 1024 and preset("nonsense").mode == "balanced"
    assert (resolve_workers("auto", "balanced", 16), resolve_workers("auto", "accurate", 16), resolve_workers("x", "fast", 8), resolve_workers(9, "fast", 8), resolve_workers("auto", "fast", 1)) == (4, 2, 1, 4, 1)
    assert [score_mode(m) for m in ("fast", "balanced", "accurate")] == ["conservative", "balanced", "accurate"]


def test_thumbnails_are_written_once(spark, tmp_path):
    from lumenpick.operators.thumbnails import write_thumbnails

    png(tmp_path / "big.png", [[x % 256 for x in range(720)] for _ in range(300)])
    (tmp_path / "broken.png").write_bytes(b"no image")
    found = photos.decoded(spark, str(tmp_path))
    done = {r["path"].rsplit("/", 1)[1]: r for r in write_thumbnails(found, str(tmp_path / "thumbs")).collect()}
    assert done["big.png"]["error"] is None and done["broken.png"]["error"]
    size = photos.sizes(photos.decoded(spark, str(tmp_path / "thumbs"))).first()
    assert (size["width"], size["height"]) == (360, 150)
    made = spark.createDataFrame([(done["big.png"]["thumbnail_path"],)], "thumbnail_path string")
    assert write_thumbnails(found, str(tmp_path / "thumbs"), made).count() == 1


def test_progress_is_told(spark, tmp_path):
    import time

    from lumenpick.streaming.progress import ProgressListener, stage

    seen = []
    listener = ProgressListener(seen.append)
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
        for _ in range(100):
            if seen and seen[-1].stage == "finished":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert seen[0].stage == "started" and seen[-1].stage == "finished" and max(p.current for p in seen) == 5
    with stage("scan", 1, 2, seen.append):
        pass
    assert (seen[-1].current, seen[-1].total) == (1, 2)


@pytest.mark.parametrize("threshold", range(0, 21, 4))
def test_close_pairs_lose_none(spark, threshold):
    """Pairs whose differing bits are spread over all bands, and pairs just within and beyond the bound."""
    rng, hashes = random.Random(threshold), [0, 0x0101010101010101, 0x1111111111111111, -1]
    for base in (0, rng.getrandbits(63)):
        for n in (max(0, threshold - 1), threshold, threshold + 1):
            for _ in range(6):
                at = [64 * i // max(1, n) for i in range(n)] if rng.random() < 0.5 else rng.sample(range(64), n)
                flipped = base
                for bit in at:
                    flipped ^= 1 << bit
                hashes.append(flipped - (1 << 64) if flipped >= 1 << 63 else flipped)
        hashes.append(base)
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(hashes))), "id long, hash long")
    got, want = (sorted(map(tuple, f(df, threshold).collect())) for f in (similarity.close_pairs, similarity.compared_pairs))
    assert got == want and (got or not threshold)


def test_numbers_follow_a_global_order(spark):
    from lumenpick.operators.numbering import numbered

    rows = [(random.Random(i).randrange(50), i) for i in range(400)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), F.desc("a"), "b").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["number"])] == sorted(rows, key=lambda x: (-x[0], x[1])) and {r["number"] for r in got} == set(range(1, 401))
    assert numbered(spark.createDataFrame([], "a int"), "a").count() == 0


def test_boxes_off_the_image():
    image = np.full((1, 80, 80), 120)
    image[0, ::6] = 255
    off = pixels.faces(image, [(200, 200, 10, 10), (300, 0, 5, 5)])
    assert (off["face_count"][0], off["face_sharpness"][0], off["face_score"][0]) == (2, 0.0, 0.12)
    plain, fallen = pixels.body(image), pixels.body(image, [(200, 200, 10, 10)])
    assert all(plain[k][0] == fallen[k][0] for k in plain) and plain["person_detected"][0]
    tiny = pixels.body(np.full((1, 6, 6), 9))
    assert (tiny["person_detected"][0], tiny["body_blur_penalty"][0], tiny["subject_score"][0]) == (False, 1.0, 0.0)
    assert pixels.body(np.zeros((1, 0, 5), int))["body_blur_penalty"][0] == 0.0


def test_images_are_turned_upright():
    image = np.arange(6).reshape(2, 3)
    turned = {1: image, 2: image[:, ::-1], 3: np.rot90(image, 2), 4: image[::-1], 5: image.T, 6: np.rot90(image, -1), 7: image.T[::-1, ::-1], 8: np.rot90(image, 1), None: image, 99: image}
    for orientation, want in turned.items():
        assert np.array_equal(pixels.upright(image, orientation), want), orientation
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<I", 0)
    assert photos.orientation(b"\xff\xd8\xff\xe1xxExif\0\0" + tiff) == 6 and photos.orientation(b"none") == 1


def test_whole_records_and_groups_of_paths(spark, tmp_path):
    lines, flat = [[255 if x % 6 == 0 else 0 for x in range(96)] for _ in range(96)], [[80] * 48 + [200] * 48 for _ in range(96)]
    for name, image in (("a.png", lines), ("b.png", lines), ("c.png", flat)):
        png(tmp_path / name, image)
    (tmp_path / "broken.png").write_bytes(b"no image")
    decoded = photos.decoded(spark, str(tmp_path))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    sizes = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").alias("file_size"), F.unix_micros("modificationTime").alias("modified"))
    records = images.photo_records(images.analysed(decoded, preset("fast")), sizes, preset("fast"))
    got = {r["file_name"]: r for r in records.collect()}
    assert got["broken.png"]["status"] == "rejected" and got["broken.png"]["photo_id"] == got["broken.png"]["path"] and got["broken.png"]["reasons"][0].startswith("Analysis failed: ")
    assert got["a.png"]["reasons"] == [images.BODY_SKIPPED] and len(got["a.png"]["photo_id"]) == 40 and got["a.png"]["file_size"] > 0 and got["a.png"]["analysis_size"] == 1024
    kept = images.cache_rows(records)
    assert kept.count() == 3 and {r["analysis_mode"] for r in kept.collect()} == {"fast"}
    groups = {r["path"].rsplit("/", 1)[1]: (r["cluster_id"], r["cluster_size"]) for r in images.path_groups(decoded, threshold=4).collect()}
    assert groups == {"a.png": ("CL0001", 2), "b.png": ("CL0001", 2), "broken.png": ("CL0002", 1), "c.png": ("CL0003", 1)}
    item = photos.photo_items(files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")), decoded).filter("file_name = 'a.png'").first()
    assert (item["width"], item["height"], item["camera"]) == (96, 96, None) and item["created_at"] is not None


def test_plug_ins(spark):
    assert images.face_count(lambda image: [(0, 0, 40, 40), (0, 0, 20, 40)], np.zeros((60, 80), np.uint8)) == 1
    model = lambda image: [(0, 0.9, 1, 2, 11, 22), (0, 0.2, 0, 0, 5, 5), (3, 0.9, 0, 0, 5, 5)]
    assert images.persons_of(model)(None) == [(1, 2, 10, 20)] and images.persons_of(None)(None) == []
    row = spark.range(1).select(scoring.aesthetic_score(), scoring.aesthetic_score(lambda a: a * 2.0, F.lit(0.3)), scoring.aesthetic_score(lambda a: a, F.lit(None).cast("double"))).first()
    assert list(row) == [0.5, 0.6, 0.5]


def test_copies_never_overwrite(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (out / "02_FINAL_DECISION" / "Posts").mkdir(parents=True)
    source.mkdir()
    (out / "02_FINAL_DECISION" / "Posts" / "a.jpg").write_bytes(b"earlier")
    for folder in ("x", "y"):
        (source / folder).mkdir()
        (source / folder / "a.jpg").write_bytes(folder.encode())
    items = spark.createDataFrame([("1", "a.jpg", str(source / "x" / "a.jpg"), "post"), ("2", "a.jpg", str(source / "y" / "a.jpg"), "post"), ("3", "b.jpg", str(source / "b.jpg"), "delete"), ("4", "c.jpg", "/c.jpg", "undecided")],
                                  "photo_id string, filename string, original_path string, final_decision string")
    plan = export.decision_plan(items, str(out), export.existing_files(spark, str(out)))
    errors = {r["source"].rsplit("/", 2)[-2]: r["error"] for r in export.run_copies(spark.createDataFrame(plan.collect(), plan.schema)).collect()}
    assert errors["x"] is errors["y"] is None and errors["in"]
    posts = out / "02_FINAL_DECISION" / "Posts"
    assert {f.name: f.read_bytes() for f in posts.iterdir()} == {"a.jpg": b"earlier", "a_1.jpg": b"x", "a_2.jpg": b"y"}
    clash = spark.createDataFrame([(str(source / "x" / "a.jpg"), str(posts / "a.jpg")), (str(source / "x" / "a.jpg"), str(posts / "a_1.jpg"))], "source string, destination string")
    assert sorted((r["error"] or "done").split(":")[0] for r in export.run_copies(clash).collect()) == ["done", "the destination exists"] and (posts / "a.jpg").read_bytes() == b"earlier"
    assert export.existing_files(spark, str(tmp_path / "none")).count() == 0
    failed = spark.createDataFrame([("p", "/q/p.jpg", "p.jpg", "error", 1), ("r", "/q/r.jpg", "r.jpg", "odd", 2)], "photo_id string, path string, file_name string, status string, seq int")
    assert [r["output_path"] for r in export.with_output_path(failed, "/o").orderBy("seq").collect()] == ["/o/04_REPORT/errors/p.jpg", "/o/04_REPORT/errors/r.jpg"]


def test_json_caches(spark, tmp_path):
    record = {"cache_key": "k", "photo_id": "p", "path": "/a.jpg", "file_size": 5, "mtime": 12.5, "technical": {"sharpness": 0.5}, "face": {"face_count": 2}, "body": {}, "final_score": 0.7, "analysis_mode": "fast"}
    path = tmp_path / "analysis_cache.json"
    assert stores.cache_from_json(spark, str(path)).count() == 0
    path.write_text(json.dumps({"k": record, "odd": 3}))
    got = stores.cache_from_json(spark, str(path)).collect()
    assert [(r["cache_key"], r["modified"], r["sharpness"], r["face_count"], r["final_score"]) for r in got] == [("k", 12_500_000, 0.5, 2, 0.7)]
    path.write_text("{broken")
    assert stores.cache_from_json(spark, str(path)).count() == 0
    (tmp_path / "analysis").mkdir()
    (tmp_path / "analysis" / "1.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "analysis" / "2.json").write_text("nothing")
    assert [r["photo_id"] for r in stores.cache_from_files(spark, str(tmp_path / "analysis")).collect()] == ["p"]
    store = str(tmp_path / "store")
    stores.replaced(stores.cache_from_files(spark, str(tmp_path / "analysis")), store)
    stores.replaced(stores.stored(spark, store, stores.CACHE).withColumn("ai_status", F.lit("review")), store)
    assert [r["ai_status"] for r in stores.stored(spark, store, stores.CACHE).collect()] == ["review"] and stores.stored(spark, str(tmp_path / "no"), stores.CACHE).count() == 0


def test_the_audit_is_written_in_parts(spark, tmp_path):
    one = picking.picked(items(spark, ("a", "1", 0.5, {}), ("b", "1", 0.4, {}))).withColumn("reasons", picking.reasons("balanced"))
    path = reports.write_audit(one, str(tmp_path), preset("balanced"), mode="balanced")
    read = lambda n: spark.read.json(f"{path}/{n}").collect()
    assert (read("summary")[0]["totalPhotos"], read("performance")[0]["maxAnalysisSize"], len(read("photos")), read("clusters")[0]["selectedPhotoId"]) == (2, 1600, 2, "a")
