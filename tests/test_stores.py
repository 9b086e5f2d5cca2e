"""What stores write they read again, and no crash loses rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lumenpick.operators.review import latest_decisions
from lumenpick.sources import stores
from lumenpick.sources.documents import KEYED, LIST, ONE, write_document
from lumenpick.sources.generations import KEPT, Store
from lumenpick.streaming.incremental import keyed_upserts, latest_upserts

DECISIONS = [("b", "b.jpg", "/x/b.jpg", "review", "post", "manual", "2024-05-01T10:00:00", 'says "no"\nand é'), ("a", "a.jpg", "/x/a.jpg", "selected", "undecided", "user", None, "")]
CACHED = {"cache_key": "k", "photo_id": "p", "path": "/a.jpg", "file_size": 5, "modified": 12_345_678, "phash": "00ff", "sharpness": 0.5, "exposure": 0.25, "face_detected": True, "face_count": 2, "subject_score": 0.1, "final_score": 0.7,
          "width": 30, "cluster_id": "CL0001", "ai_status": "review", "analysis_mode": "fast", "analysis_size": 1024, "cache_version": "1", "scoring_version": "2"}


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("form", ["document", "lines"])
def test_decisions_are_read_as_written(spark, tmp_path, form):
    rows, path = spark.createDataFrame(DECISIONS, stores.DECISION), str(tmp_path / "decisions.json")
    if form == "document":
        stores.write_json_store(stores.decisions_to_json(rows), path)
        assert list(json.load(open(path))) == ["a", "b"] and json.load(open(path))["b"]["notes"] == DECISIONS[0][-1]
    else:
        stores.decisions_to_json(rows).select("record").write.text(path)
    got = stores.decisions_from_json(spark, path).select(rows.columns)
    assert same(got, rows)
    stores.write_json_store(stores.decisions_to_json(got.filter("photo_id = 'a'")), str(tmp_path / "again.json"))
    assert stores.decisions_from_json(spark, str(tmp_path / "again.json")).count() == 1


@pytest.mark.parametrize("form", ["document", "lines", "files"])
def test_caches_are_read_as_written(spark, tmp_path, form):
    names = [c.split()[0] for c in stores.CACHE.split(", ")]
    rows = spark.createDataFrame([tuple(CACHED.get(n) for n in names), tuple({"cache_key": "j", "path": "/b"}.get(n) for n in names)], stores.CACHE)
    path = str(tmp_path / "cache.json")
    if form == "document":
        stores.write_json_store(stores.cache_to_json(rows), path)
        assert json.load(open(path))["k"]["technical"]["sharpness"] == 0.5
        got = stores.cache_from_json(spark, path)
    elif form == "lines":
        stores.cache_to_json(rows).select("record").write.text(path)
        got = stores.cache_from_json(spark, path)
    else:
        folder = tmp_path / "analysis"
        folder.mkdir()
        for r in rows.collect():
            (folder / f"{r.cache_key}.json").write_text(json.dumps({k: v for k, v in r.asDict().items() if v is not None}, indent=2))
        (folder / "bad.json").write_text("{")
        got = stores.cache_from_files(spark, str(folder))
    assert same(got.select(names), rows)


def test_documents(spark, tmp_path):
    rows = spark.createDataFrame([("list", None, json.dumps({"n": i}), i) for i in random.Random(1).sample(range(500), 500)] + [("head", None, '{"a": 1}', 0), ("by", "k\"2", "2", 2), ("by", "k1", "1", 1)], "section string, key string, record string, n int")
    path = tmp_path / "deep" / "out.json"
    write_document(rows.repartition(7), str(path), [("head", ONE), ("none", ONE), ("list", LIST), ("by", KEYED), ("empty", LIST)], "n")
    got = json.loads(path.read_text())
    assert list(got) == ["head", "none", "list", "by", "empty"] and got["head"] == {"a": 1} and got["none"] is None and got["empty"] == []
    assert [x["n"] for x in got["list"]] == list(range(500)) and got["by"] == {"k1": 1, 'k"2': 2}
    assert [p.name for p in path.parent.iterdir()] == ["out.json"]


def test_an_aborted_document_changes_nothing(spark, tmp_path):
    path = tmp_path / "out.json"
    path.write_text("[]")
    bad = spark.range(0, 100, 1, 4).select(F.lit("").alias("section"), F.lit("k").alias("key"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("1").alias("record"), "id")
    with pytest.raises(Exception, match="broken"):
        write_document(bad, str(path), [("", KEYED)], "id")
    assert path.read_text() == "[]" and [p.name for p in tmp_path.iterdir()] == ["out.json"]


def test_generations(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"), "k int, v string")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    assert store.read().count() == 0 and store.versions() == []
    store.replace(frame((1, "a")))
    store.append(frame((2, "b")))
    assert sorted(map(tuple, store.read().collect())) == [(1, "a"), (2, "b")]
    earlier = set(store.folders())
    store.append(frame((3, "c")))
    assert earlier < set(store.folders())  # nothing was rewritten
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda self, folders: (_ for _ in ()).throw(RuntimeError("killed")))
        for write in (store.replace, store.append):
            with pytest.raises(RuntimeError):
                write(frame((9, "lost")))
    assert sorted(r.k for r in store.read().collect()) == [1, 2, 3]
    orphans = {p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("data-")} - set(store.folders())
    assert len(orphans) == 2
    store.vacuum()
    assert {p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("data-")} == set(store.folders())
    store.replace(store.read().filter("k > 1"))  # read from the store itself
    store.fold(lambda rows: rows.filter("k > 2"), at=1)
    assert [r.k for r in store.read().collect()] == [3] and len(store.folders()) == 1 and len(store.versions()) == KEPT
    other = Store(spark, str(tmp_path / "store"), "k int, v string, w double")
    assert [tuple(r) for r in other.read().collect()] == [(3, "c", None)]
    (tmp_path / "store" / "versions" / f"{store.versions()[-1] + 1:012d}").write_text("")
    monkeypatch.setattr(Store, "versions", lambda self: [store_versions])
    store_versions = sorted(int(p.name) for p in (tmp_path / "store" / "versions").iterdir() if p.name.isdigit())[-2]
    with pytest.raises(RuntimeError, match="another writer"):
        store.replace(frame((4, "d")))


def test_a_killed_stream_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    """One file a batch; the write of the third batch dies after its rows are written, then once more before."""
    schema = "photo_id string, at long, final_decision string"
    rng, rows = random.Random(3), []
    for n in range(5):
        rows.append([(f"p{rng.randrange(12) if rng.random() < 0.6 else 0}", rng.randrange(40), rng.choice(["post", "save", None])) for _ in range(30)])
        spark.createDataFrame(rows[-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        keyed_upserts(stream, str(tmp_path / "store"), schema, "photo_id", ("at",), str(tmp_path / "cp")).awaitTermination()

    publish, append, count = Store._publish, Store.append, [0]

    def dying(self, folders):
        count[0] += 1
        if count[0] == 3:
            raise RuntimeError("killed after the rows were written")
        publish(self, folders)

    def dying_first(self, rows):
        raise RuntimeError("killed before")

    monkeypatch.setattr(Store, "_publish", dying)
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.setattr(Store, "_publish", publish)
    store = Store(spark, str(tmp_path / "store"), schema)
    early = set(store.folders())
    assert len(early) == 2
    monkeypatch.setattr(Store, "append", dying_first)
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.setattr(Store, "append", append)
    run()
    log = spark.createDataFrame([r for batch in rows for r in batch], schema)
    assert same(latest_upserts(store, "photo_id", ("at",)), latest_decisions(log, "photo_id", ("at",)))
    assert early <= set(store.folders()) and store.read().count() < log.count()
