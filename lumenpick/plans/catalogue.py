"""Registered queries over the given tables, each beside its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import preset
from ..functions import scalars as s
from ..operators import cache, detection, export, images, picking, reports, review, scoring, similarity
from ..sources import listing
from . import fixtures as f
from .oracles import ORACLES
from .storage import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MODES = ("conservative", "balanced", "aggressive")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def tile_pick_status(spark, sf_dir):
    return picking.picked(f.scored_tiles(spark, sf_dir, "balanced"), "balanced").groupBy("cluster_id", "status").agg(F.count("*").alias("n"))


@query
def tile_technical(spark, sf_dir):
    return images.with_technical(f.tiles(spark, sf_dir)).select("vec_id", "label", "laplacian", "brightness", "sharpness", "exposure", "contrast", "global_blur_penalty")


@query
def tile_gradient(spark, sf_dir):
    return images.with_technical(f.tiles(spark, sf_dir)).select("vec_id", "gradient")


@query
def tile_body(spark, sf_dir):
    return images.with_body(f.tiles(spark, sf_dir)).select("vec_id", "person_detected", "body_sharpness", "body_blur_penalty", "subject_score")


@query
def tile_faces(spark, sf_dir):
    return images.with_faces(f.tiles(spark, sf_dir), f.FACE_BOXES).select("vec_id", "face_detected", "face_count", "face_sharpness", "face_score")


@query
def tile_boxes(spark, sf_dir):
    """Boxes that a small cascade finds in tiles, by a table function joined laterally."""
    return detection.boxes(f.tiles(spark, sf_dir), f.CASCADE, images.TILE, neighbours=0, largest=1.0).select("vec_id", "x", "y", "w", "h")


@query
def tile_box_faces(spark, sf_dir):
    """Tiles with the number of boxes found in them."""
    tiled = f.tiles(spark, sf_dir)
    found = detection.boxes(tiled, f.CASCADE, images.TILE, neighbours=0, largest=1.0).select("vec_id", "x", "y", "w", "h")
    return detection.faces_in_boxes(tiled, found, "vec_id", images.TILE).select("vec_id", "face_count", "face_detected")


@query
def local_patch_blur(spark, sf_dir):
    return images.with_blurred_patches(f.tiles(spark, sf_dir)).select("vec_id", "blurred_share", "localized_blur")


@query
def exposure_classes(spark, sf_dir):
    t = images.with_technical(f.tiles(spark, sf_dir))
    return t.groupBy("label", scoring.exposure_class(F.col("brightness")).alias("exposure_class"), scoring.is_blurred(F.col("laplacian")).alias("blurred")).agg(F.count("*").alias("n"))


for _mode in MODES:

    def _final(spark, sf_dir, mode=_mode):
        return f.scored_tiles(spark, sf_dir, mode).select("vec_id", "final_score")

    def _pick(spark, sf_dir, mode=_mode):
        return picking.picked(f.line_items(spark, sf_dir, mode), mode).select("photo_id", "cluster_id", "rank", "cluster_size", F.col("winner.photo_id").alias("winner_id"), "score_gap", "duplicate_penalty", "status")

    def _simple(spark, sf_dir, mode=_mode):
        return picking.simply_picked(f.line_items(spark, sf_dir), mode).select("photo_id", "rank", "status")

    def _reasons(spark, sf_dir, mode=_mode):
        return _explained(spark, sf_dir, mode).select("photo_id", "status", F.array_join("reasons", "; ").alias("reasons"))

    QUERIES |= {f"final_score_{_mode}": _final, f"pick_{_mode}": _pick, f"pick_simple_{_mode}": _simple, f"reasons_{_mode}": _reasons}


def _explained(spark, sf_dir, mode="balanced"):
    return picking.picked(f.line_items(spark, sf_dir, mode), mode, dealt=f.line_items(spark, sf_dir, mode, dealt=True)).withColumn("reasons", picking.reasons(mode))


@query
def legacy_scores(spark, sf_dir):
    c = F.col
    i = f.line_items(spark, sf_dir)
    technical = scoring.technical_with_penalty(c("sharpness"), c("exposure"), c("contrast"))
    raw_body = F.when(c("face_detected"), c("body_sharpness") * s.num(180))
    local = c("body_blur_penalty") >= 0.45
    sharp, penalty = scoring.body_from_raw(raw_body, local)
    counted = scoring.counted_face_score(c("face_count"))
    blurred = scoring.is_blurred(c("sharpness") * s.num(300))
    kind = scoring.exposure_class(c("exposure") * s.num(255))
    points = scoring.point_score(blurred, kind == "UNDEREXPOSED", kind == "OVEREXPOSED", c("face_detected"), c("contrast") > 0.5, c("face_count") > 2)
    return i.select(
        "photo_id", technical.alias("technical"), scoring.blended_technical(c("sharpness"), c("exposure"), c("contrast")).alias("blended"), counted.alias("counted_face"),
        sharp.alias("body"), penalty.alias("penalty"), scoring.weighted_final(technical, F.when(c("face_detected"), counted), sharp, scoring.aesthetic_score(), penalty).alias("weighted"),
        points.alias("points"), scoring.point_status(points).alias("point_status"),
        scoring.human_quality(c("face_detected"), c("sharpness") * s.num(300), raw_body, F.when(c("contrast") > 0.2, raw_body), local, kind).alias("human"),
        scoring.notes(blurred, kind, c("face_detected"), c("contrast") > 0.5, c("face_count") > 2).alias("notes"),
    )


@query
def cluster_summary(spark, sf_dir):
    return reports.cluster_summary(picking.picked(f.line_items(spark, sf_dir)))


@query
def run_summary(spark, sf_dir):
    return reports.run_summary(reports.flat_rows(_explained(spark, sf_dir)))


@query
def engine_summary(spark, sf_dir):
    return reports.engine_summary(picking.picked(f.line_items(spark, sf_dir)))


@query
def status_warnings(spark, sf_dir):
    c = F.col
    w = scoring.review_warnings(c("body_blur_penalty"), c("face_score"), c("final_score"))
    return picking.picked(f.line_items(spark, sf_dir)).filter(c("status") != "selected").select("photo_id", F.array_join(w, "; ").alias("warnings"), s.percent_label(c("final_score")).alias("label"))


@query
def report_rows(spark, sf_dir):
    return reports.audit_rows(reports.stamped(_explained(spark, sf_dir), mode="balanced", performance_mode="balanced", analysis_size=1600))


@query
def flat_report_rows(spark, sf_dir):
    return reports.flat_rows(_explained(spark, sf_dir))


def _json_fields(records: DataFrame, texts: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """The fields of JSON records at the given paths in place of the records; a record is parsed once for all of them."""
    tree: dict = {}
    for path, kind in [*[(p, "string") for p in texts], *[(p, "double") for p in numbers]]:
        *above, last = path.split(".")
        reduce(lambda node, name: node.setdefault(name, {}), above, tree)[last] = kind
    ddl = lambda node: ", ".join(f"{n}: {k if isinstance(k, str) else f'struct<{ddl(k)}>'}" for n, k in node.items())
    parsed = records.withColumn("record", F.from_json("record", f"struct<{ddl(tree)}>"))
    return parsed.withColumns({p.rsplit(".", 1)[-1]: F.col(f"record.{p}") for p in (*texts, *numbers)}).drop("record")


@query
def report_json(spark, sf_dir):
    texts = ("filename", "status", "cluster_id", "is_cluster_winner", "clusterWinnerFilename")
    numbers = [f"scoreBreakdown.{n}" for n in ("finalScore", "scorePercent", "technical.globalBlurPenalty", "face.faceCount", "body.subjectScore")]
    return _json_fields(reports.audit_json(_explained(spark, sf_dir)), texts, numbers).withColumnsRenamed({"cluster_id": "clusterId", "is_cluster_winner": "isClusterWinner"})


@query
def audit_records(spark, sf_dir):
    """All fields of the JSON report's photo records."""
    rows = reports.audit_rows(reports.stamped(_explained(spark, sf_dir), mode="balanced", performance_mode="balanced", analysis_size=1600))
    record = reports.audit_json(reports.stamped(_explained(spark, sf_dir), mode="balanced", performance_mode="balanced", analysis_size=1600))
    more = "outputPath string, thumbnailPath string, clusterWinnerFilename string, scoreGapFromWinner double, reasonsList array<string>"
    more += ", scoreBreakdown struct<technical: struct<sharpness: double>, face: struct<faceScore: double>, body: struct<personDetected: boolean>, duplicatePenalty: double>"
    r = record.select(F.from_json("record", ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", " + more).alias("r")).select("r.*")
    return r.withColumns({
        "reasonsList": F.array_join("reasonsList", "; "), "sharpness": F.col("scoreBreakdown.technical.sharpness"), "faceScore": F.col("scoreBreakdown.face.faceScore"),
        "personDetected": F.col("scoreBreakdown.body.personDetected"), "duplicatePenalty": F.col("scoreBreakdown.duplicatePenalty"),
    }).drop("scoreBreakdown")


@query
def cluster_winners(spark, sf_dir):
    """The JSON report's clusters from their pieces: winner, photos and the winner's own record."""
    piece = reports.cluster_pieces(_explained(spark, sf_dir))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), ","))
    parsed = F.from_json("record", "clusterId string, selectedPhotoId string, winner struct<filename: string, status: string, final_score: double>, photos array<struct<photoId: string>>")
    r = piece.groupBy("cluster_id").agg(text.alias("record")).select(parsed.alias("r")).select("r.*")
    return r.select(F.col("clusterId").alias("cluster_id"), F.col("selectedPhotoId").alias("selected"), F.col("winner.filename").alias("winner_name"), F.col("winner.status").alias("winner_status"), F.col("winner.final_score").alias("best_score"), F.size("photos").cast("long").alias("photos"))


@query
def cluster_json(spark, sf_dir):
    record = reports.cluster_json(_explained(spark, sf_dir))
    parsed = F.from_json("record", "selectedPhotoId string, photos array<struct<photoId: string, scoreBreakdown: struct<finalScore: double>>>")
    parsed = record.select("cluster_id", parsed.alias("r"))
    return parsed.select("cluster_id", F.col("r.selectedPhotoId").alias("selected"), F.array_join("r.photos.photoId", ",").alias("photos"), F.col("r.photos.scoreBreakdown.finalScore")[0].alias("best_score"))


@query
def hamming_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select(F.col("vec_id").alias("id"), similarity.bit_signature(F.col("embedding")).alias("hash"))
    return similarity.close_pairs(v, 18)


def _simhashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), similarity.simhash60(F.col("text")).alias("hash"))


@query
def similarity_clusters(spark, sf_dir):
    g = similarity.grouped(_simhashes(spark, sf_dir), width=similarity.SIMHASH_BITS).withColumn("name", F.concat(F.lit("Doc"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(".jpg"))).withColumn("seq", F.col("id"))
    out = similarity.labelled(g)
    return out.select("id", "component", "cluster_id", "cluster_size", "confidence", similarity.duplicate_label(F.col("cluster_size"), F.col("cluster_id")).alias("duplicate_group"))


@query
def exact_duplicates(spark, sf_dir):
    h = _simhashes(spark, sf_dir).filter("hash is not null")
    return h.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").select("first_id", "copies")


@query
def main_person_box(spark, sf_dir):
    def at(i):
        return F.floor(s.num(100) + F.get("embedding", i).cast("double") * s.num(150))

    boxes = F.array(*[F.struct(at(4 * k).alias("x"), at(4 * k + 1).alias("y"), F.abs(at(4 * k + 2)).alias("w"), F.abs(at(4 * k + 3)).alias("h")) for k in range(4)])
    b = scoring.main_box(boxes, F.lit(640), F.lit(480))
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 16).select("vec_id", b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))


@query
def crop_geometry(spark, sf_dir):
    w, h = (F.col("vec_id") * 37 % 1900 + 50), (F.col("vec_id") * 53 % 1400 + 50)
    g = scoring.crop_geometry(w, h, 0.5, 0.55, 1024)
    return table(spark, sf_dir, "embeddings").select("vec_id", g["left"].alias("left_edge"), g["top"].alias("top_edge"), g["side"].alias("side"))


@query
def decisions_latest(spark, sf_dir):
    return review.latest_decisions(f.decision_log(spark, sf_dir), order=("decision_updated_at", "event_id")).select("photo_id", "event_id", "final_decision")


def _reviewed(spark, sf_dir):
    log = review.latest_decisions(f.decision_log(spark, sf_dir), order=("decision_updated_at", "event_id")).withColumn("decision_updated_at", F.col("decision_updated_at").cast("string"))
    return review.with_decisions(review.review_items(f.review_rows(spark, sf_dir)), log)


@query
def review_merge(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("photo_id", "filename", "ai_status", "final_decision", "cluster_id", "is_cluster_winner", "final_score", F.array_join("reasons", "|").alias("reasons"))


@query
def review_progress(spark, sf_dir):
    return review.progress(_reviewed(spark, sf_dir))


@query
def review_bucket(spark, sf_dir):
    return review.in_bucket(_reviewed(spark, sf_dir), "ai_status", "anything").select("photo_id", "final_decision")


@query
def review_mixed_rows(spark, sf_dir):
    rows = review.review_items(f.mixed_rows(spark, sf_dir))
    return rows.select("photo_id", "filename", "original_path", "ai_status", "cluster_id", "is_cluster_winner", "final_score", F.array_join("reasons", "|").alias("reasons"))


@query
def decision_copies(spark, sf_dir):
    """Copies by decision into folders where some files are already."""
    r = _reviewed(spark, sf_dir)
    there = r.filter("cast(photo_id as long) % 5 = 0").select(F.lit("02_FINAL_DECISION/Posts").alias("folder"), F.element_at(F.split("original_path", "/"), -1).alias("file_name"))
    return export.decision_plan(r, "/out", there)


@query
def collision_existing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "-"), F.lit(".jpg")).alias("file_name"), F.lit("01_SELECTED").alias("folder"), F.col("p_partkey").alias("seq"))
    there = p.filter("p_partkey % 3 = 0").select("folder", "file_name").unionByName(p.filter("p_partkey % 7 = 0").select("folder", F.regexp_replace("file_name", r"\.jpg$", "_2.jpg").alias("file_name")))
    return export.collision_free(p, existing=there).select("p_partkey", "destination_name")


@query
def neighbours_of_item(spark, sf_dir):
    items = _reviewed(spark, sf_dir).withColumn("seq", F.col("photo_id").cast("long"))
    ends = items.agg(F.min("seq").alias("first"), F.max("seq").alias("last")).first()
    asked = (("last", str(ends["last"])), ("first", str(ends["first"])), ("unknown", "no such id"))
    out = [review.neighbour(items, photo, step).select(F.lit(name).alias("asked"), F.lit(step).alias("step"), "photo_id") for name, photo in asked for step in (1, -1)]
    return reduce(lambda a, b: a.unionByName(b), out)


@query
def first_report_rows(spark, sf_dir):
    return reports.first_rows(_explained(spark, sf_dir))


@query
def first_summary(spark, sf_dir):
    return reports.first_summary(reports.first_rows(_explained(spark, sf_dir)))


@query
def shown_of(spark, sf_dir):
    return reports.limited(_listed_parts(spark, sf_dir).filter("has_face"), [F.desc("final_score"), F.col("p_partkey")], 120).select("p_partkey", "shown_of")


@query
def result_summary(spark, sf_dir):
    record = reports.result_summary(picking.picked(f.line_items(spark, sf_dir)), "balanced")
    return _json_fields(record, ("mode",), ("totalPhotos", "selectedCount", "reviewCount", "rejectedCount", "clusterCount", "averageFinalScore"))


@query
def export_counts(spark, sf_dir):
    r = _reviewed(spark, sf_dir)
    return export.export_counts(r, r.filter("cast(photo_id as long) % 4 <> 0"))


@query
def missing_files(spark, sf_dir):
    r = _reviewed(spark, sf_dir)
    return export.missing_files(r, r.filter("cast(photo_id as long) % 4 <> 0")).select("photo_id", "original_path")


@query
def collision_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "-"), F.lit(".jpg")).alias("file_name"), F.lit("01_SELECTED").alias("folder"), F.col("p_partkey").alias("seq"))
    return export.collision_free(p).select("p_partkey", "destination_name")


@query
def ring_navigation(spark, sf_dir):
    return review.ring(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn").select("conv_id", "turn", "next_id", "previous_id")


def _listed_parts(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select(
        c("p_partkey"), c("p_name").alias("filename"), F.upper(F.split("p_type", " ")[0]).alias("output_status"), scoring.exposure_class(c("p_size") * s.num(6)).alias("exposure_status"),
        (c("p_size") < 20).alias("is_blur"), (c("p_partkey") % 2 == 0).alias("has_face"), c("p_retailprice").alias("final_score"),
    )


@query
def result_filter(spark, sf_dir):
    rows = review.filtered(_listed_parts(spark, sf_dir), exposures=("NORMAL", "OVEREXPOSED"), blur=False, face=True)
    return rows.orderBy(F.desc("final_score"), "p_partkey").limit(60).select("p_partkey", "filename", "final_score")


@query
def name_search(spark, sf_dir):
    return review.filtered(_listed_parts(spark, sf_dir), search="^[a-m].*E").select("p_partkey", "filename")


@query
def cache_hits(spark, sf_dir):
    now, old = f.cached_and_current(spark, sf_dir)
    return cache.hits(now, old, preset("balanced")).select("path", "file_size", "modified")


@query
def cache_misses(spark, sf_dir):
    now, old = f.cached_and_current(spark, sf_dir)
    return cache.misses(now, old, preset("balanced")).select("path", "file_size", "modified")


@query
def cache_keys(spark, sf_dir):
    now, _ = f.cached_and_current(spark, sf_dir)
    return now.select("path", cache.cache_key(F.col("path")).alias("cache_key"), cache.photo_id(F.col("path"), F.col("file_size"), F.col("modified")).alias("photo_id"))


@query
def path_parts(spark, sf_dir):
    name = s.file_name(F.col("path"))
    return f.files(spark, sf_dir).select("page_id", name.alias("name"), s.stem(name).alias("stem"), s.suffix(name).alias("suffix"), s.parent(F.col("path")).alias("parent"))


@query
def scan_filter(spark, sf_dir):
    return f.files(spark, sf_dir).filter(listing.is_image(F.col("path")) & ~listing.generated(F.col("path"))).select("page_id", "path")


@query
def extensions_distinct(spark, sf_dir):
    return f.files(spark, sf_dir).select(F.lower(s.suffix(s.file_name(F.col("path")))).alias("extension")).distinct()


@query
def status_split(spark, sf_dir):
    p = picking.picked(f.line_items(spark, sf_dir))
    return p.filter("status = 'selected'").select("photo_id", F.lit("kept").alias("side")).unionByName(p.filter("status = 'rejected'").select("photo_id", F.lit("dropped").alias("side")))


@query
def person_blur_stats(spark, sf_dir):
    def at(i):
        return F.get("embedding", i).cast("double")

    boxes = F.array(*[F.struct(F.abs(F.floor(at(3 * k) * s.num(100))).alias("w"), F.abs(F.floor(at(3 * k + 1) * s.num(100))).alias("h"), s.rounded(at(3 * k + 2) * s.num(200)).alias("sharpness")) for k in range(3)])
    b = scoring.person_blur(F.filter(boxes, lambda x: x["w"] * x["h"] > 0))
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 9).select("vec_id", b["count"].alias("persons"), b["main"].alias("main"), b["mean"].alias("mean_blur"), b["least"].alias("least"))


@query
def cluster_models(spark, sf_dir):
    m = similarity.cluster_models(picking.picked(f.line_items(spark, sf_dir)))
    return m.select("cluster_id", F.array_join("photo_ids", ",").alias("photo_ids"), "selected_photo_id", F.array_join("rejected_photo_ids", ",").alias("rejected_photo_ids"), "size")


@query
def ungrouped_clusters(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("seq"))
    return similarity.ungrouped(names).select("id", "cluster_id", "cluster_size", "confidence")


@query
def typed_reason_rows(spark, sf_dir):
    typed = picking.typed_reasons(F.col("status"), F.col("reasons"))
    return _explained(spark, sf_dir).select("photo_id", F.explode(typed).alias("r")).groupBy("photo_id", "r.type", "r.code").agg(F.count("*").alias("n"))


@query
def decision_report(spark, sf_dir):
    return reports.decision_rows(_reviewed(spark, sf_dir)).select("photo_id", "filename", "original_path", "ai_status", "final_decision", "cluster_id", "is_cluster_winner", "final_score", "face_score", "body_sharpness", "body_blur_penalty", "decision_source", "reasons")


@query
def decision_json(spark, sf_dir):
    record = reports.decision_json(_reviewed(spark, sf_dir))
    parsed = F.from_json("record", "winner string, items array<struct<photo_id: string, ai_status: string, final_decision: string>>")
    parsed = record.select("cluster_id", "part", parsed.alias("r"))
    each = lambda field: F.array_join(F.col(f"r.items.{field}"), ",")
    return parsed.select("cluster_id", "part", F.col("r.winner").alias("winner"), each("photo_id").alias("ids"), each("ai_status").alias("statuses"), each("final_decision").alias("decisions"))


@query
def filter_choices(spark, sf_dir):
    return reports.choices(_listed_parts(spark, sf_dir), "output_status")


@query
def log_tail(spark, sf_dir):
    return reports.log_tail(f.decision_log(spark, sf_dir), ["decision_updated_at", "event_id"]).select("event_id", "photo_id", "final_decision")


@query
def display_rows(spark, sf_dir):
    return review.display_columns(_listed_parts(spark, sf_dir), ["filename", "status", "blur_level", "no_such_column", "has_face"]).groupBy("status", "blur_level").agg(F.count("*").alias("n"))


@query
def display_paths(spark, sf_dir):
    k = F.col("p_partkey")
    original, small = F.concat(F.lit("/o/"), k.cast("string")), F.concat(F.lit("/t/"), k.cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", review.displayed_path(original, small, k % 2 == 0, k % 3 == 0, True).alias("list_path"), review.displayed_path(original, small, k % 2 == 0, k % 3 == 0, False).alias("full_path")
    )


@query
def cache_after_run(spark, sf_dir):
    now, old = f.cached_and_current(spark, sf_dir)
    fresh = cache.misses(now, old, preset("balanced")).withColumn("cache_key", cache.cache_key(F.col("path"))).withColumn("analysis_error", F.when(F.col("file_size") % 10 == 0, "broken"))
    return cache.merged(old, fresh).select("path", "file_size", "modified")


@query
def item_lookup(spark, sf_dir):
    return review.item_by_id(_reviewed(spark, sf_dir), "7").select("photo_id", "filename", "ai_status")


@query
def stream_scores(spark, sf_dir):
    """Vectors arriving as files are scored by a stream and appended to a table."""
    import uuid

    from ..streaming.incremental import scored_stream

    schema = table(spark, sf_dir, "embeddings").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parquet*")
    root = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    scored_stream(stream, lambda s: images.with_technical(images.tiles(s)).select("vec_id", "sharpness", "exposure", "contrast"), f"{root}/scores", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("vec_id long, sharpness double, exposure double, contrast double").parquet(f"{root}/scores")


@query
def stream_decisions(spark, sf_dir):
    """The decision log as a stream: every batch upserts into a store; the store equals the latest decisions."""
    import uuid

    from ..sources.generations import Store
    from ..streaming.incremental import keyed_upserts, latest_upserts

    columns = f.decision_log(spark, sf_dir)
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    kind = F.col("event_type")
    final = F.when(kind == "click", "post").when(kind == "view", "save").when(kind == "error", "delete").otherwise("undecided")
    stream = raw.select(F.col("user_id").cast("string").alias("photo_id"), F.col("ts").alias("decision_updated_at"), "event_id", final.alias("final_decision"))
    schema = columns.select("photo_id", "decision_updated_at", "event_id", "final_decision").schema
    root = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    order = ("decision_updated_at", "event_id")
    keyed_upserts(stream, f"{root}/store", schema, "photo_id", order, f"{root}/checkpoint").awaitTermination()
    return latest_upserts(Store(spark, f"{root}/store", schema), "photo_id", order).select("photo_id", "event_id", "final_decision")
