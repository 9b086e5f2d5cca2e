"""The file source: odd names, relative roots, parts of bounded size, and what is built on it."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from test_operators import png

from lumenpick.config import preset
from lumenpick.operators import export, images
from lumenpick.operators.thumbnails import write_thumbnails
from lumenpick.sources import files, listing, photos


def gray(seed):
    return [[(x * seed + y * 3) % 256 for x in range(24)] for y in range(16)]


@pytest.fixture
def camera(tmp_path):
    """A card as cameras write it: leading _ and ., upper case, folders, an empty folder, a file without image."""
    for i, name in enumerate(["_DSC1.png", ".b.png", "c.PNG", "day/_DSC1.png", "day/night/.d.png", "_x/e.png", "note.txt"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        if name.endswith("txt"):
            (tmp_path / name).write_text("x")
        else:
            png(tmp_path / name, gray(i + 1))
    (tmp_path / "empty").mkdir()
    return tmp_path


def names(df, column="path"):
    return sorted(r[0] for r in df.select(column).collect())


def test_every_file_is_listed_with_size_and_time(spark, camera):
    got = {r.path: r for r in files.files_below(spark, str(camera)).collect()}
    want = [os.path.join(d, n) for d, _, found in os.walk(camera) for n in found]
    assert sorted(got) == sorted(want)
    assert all(got[p].file_size == os.path.getsize(p) and got[p].modified == os.stat(p).st_mtime_ns // 1000 for p in want)
    assert len(names(files.files_below(spark, str(camera), recursive=False))) == 4
    assert files.files_below(spark, str(camera / "none")).count() == 0 and files.files_below(spark, str(camera / "empty")).count() == 0
    assert names(files.files_below(spark, f"file://{camera}/_DSC1.png")) == [f"{camera}/_DSC1.png"]


def test_parts_are_bounded_and_planning_stats_nothing(camera, monkeypatch):
    for k in range(50):
        (camera / f"f{k:02d}").write_text("")
    monkeypatch.setattr(files, "SPREAD", 2)
    monkeypatch.setattr(os, "stat", None)
    monkeypatch.setattr(os.path, "isfile", lambda p: False)
    reader = files.PhotoReader({"path": str(camera), "chunk": "20"}, type("S", (), {"names": []}))
    parts = reader.partitions()
    assert max(len(p.files) for p in parts) == 20 and sum(len(p.files) for p in parts) >= 54
    monkeypatch.undo()
    found = [n for p in parts for n in reader._walked(None, p)]
    assert sorted(found) == sorted(os.path.join(d, n) for d, _, inner in os.walk(camera) for n in inner)


def test_contents(spark, camera):
    got = {r.path: bytes(r.content) for r in files.binary_files(spark, str(camera), recursive=True).collect()}
    assert len(got) == 7 and all(open(p.removeprefix("file://"), "rb").read() == c for p, c in got.items())


def test_odd_names_are_decoded_hashed_and_made_small(spark, camera):
    (camera / "note.txt").unlink()  # the image source would give it a row without a size
    found = photos.decoded(spark, str(camera))
    tail = lambda p: p.rsplit("/", 1)[1]
    assert sorted(tail(p) for p in names(found, "image.origin")) == [".b.png", "_DSC1.png", "c.PNG"]
    assert all(p.startswith(f"file://{camera}/") for p in names(found, "image.origin"))
    one = photos.decoded(spark, [f"{camera}/_DSC1.png", f"{camera}/c.PNG"])
    assert sorted(tail(p) for p in names(one, "image.origin")) == ["_DSC1.png", "c.PNG"] and photos.sizes(one).filter("width = 24 and height = 16").count() == 2
    assert names(photos.decoded(spark, f"{camera}/_DSC1.png"), "image.origin") == [f"file://{camera}/_DSC1.png"]
    got = {tail(r.path): r for r in images.analysed(found, preset("balanced")).collect()}
    assert len(got) == 3 and all(r.analysis_error is None and r.phash for r in got.values()) and got["_DSC1.png"].phash != got[".b.png"].phash
    assert images.path_groups(found).count() == 3
    small = write_thumbnails(found, str(camera / "small")).collect()
    assert len(small) == 3 and all(r.error is None and os.path.exists(r.thumbnail_path) for r in small)
    items = photos.photo_items(files.binary_files(spark, str(camera)), found)
    assert {r.file_name: r.width for r in items.collect()} == {"_DSC1.png": 24, ".b.png": 24, "c.PNG": 24}


def test_copies_of_odd_names_get_numbers(spark, camera, monkeypatch):
    out = camera / "out"
    (out / "01_SELECTED").mkdir(parents=True)
    (out / "01_SELECTED/_DSC1.png").write_text("taken")
    monkeypatch.chdir(camera)
    for root in (str(out), "out", "./out/", f"file://{out}"):
        there = export.existing_files(spark, root)
        assert [tuple(r) for r in there.collect()] == [("01_SELECTED", "_DSC1.png")]
    rows = spark.createDataFrame([(f"{camera}/_DSC1.png", "_DSC1.png", "selected", 1), (f"{camera}/c.PNG", "c.PNG", "odd", 2), (f"{camera}/.b.png", ".b.png", None, 3)], "path string, file_name string, status string, seq int")
    done = export.run_copies(export.copy_plan(rows, str(out), existing=export.existing_files(spark, "out"))).collect()
    assert sorted(r.destination.removeprefix(f"{out}/") for r in done) == ["01_SELECTED/_DSC1_1.png", "04_REPORT/errors/.b.png", "04_REPORT/errors/c.PNG"]
    assert all(r.error is None for r in done) and (out / "01_SELECTED/_DSC1.png").read_text() == "taken"


def test_scans_skip_what_runs_made_wherever_the_root_lies(spark, camera, monkeypatch):
    made = camera / "Trip_culled" / "01_SELECTED"
    made.mkdir(parents=True)
    png(made / "z.png", gray(9))
    assert not [p for p in names(listing.images(spark, str(camera))) if "z.png" in p]
    assert listing.folder_status(spark, str(made)) == "empty"  # an ancestor above the root counts as well
    assert names(listing.images(spark, str(made), recursive=False)) == [f"{made}/z.png"]
    monkeypatch.chdir(camera)
    assert names(listing.images(spark, ".")) == names(listing.images(spark, str(camera))) and listing.folder_status(spark, "nowhere") == "missing"
    with pytest.raises(FileNotFoundError):
        listing.listed(spark, "nowhere")
    flat = listing.images(spark, ".", recursive=False).orderBy("seq").select("file_name", "seq")
    assert [tuple(r) for r in flat.collect()] == [(".b.png", 0), ("_DSC1.png", 1), ("c.PNG", 2)]
    newest = listing.latest(listing.listed(spark, "."), r"^_DSC.*\.png$").select(F.col("file_name")).collect()
    assert [r[0] for r in newest] == ["_DSC1.png"]
