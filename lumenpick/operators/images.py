"""Quality analysis of images held in DataFrames (one Arrow pass, no shuffle)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HASH_THRESHOLD, NEUTRAL, Preset, score_mode
from ..functions import pixels
from ..functions.scalars import file_name, unsigned_hex
from ..plans.storage import written
from ..sources.stores import CACHE
from .cache import cache_key, photo_id
from .numbering import numbered
from .similarity import grouped, labelled
from .scoring import blended_technical, final_score

TILE = 8
ZOOM = 4
_METRICS = "laplacian double, brightness double, sharpness double, exposure double, contrast double, global_blur_penalty double, gradient double"
_BODY = "person_detected boolean, body_sharpness double, body_blur_penalty double, subject_score double"
_FACE = "face_detected boolean, face_count int, face_sharpness double, face_score double"

#: A detector takes a gray image and returns boxes (x, y, w, h).
Detector = Callable[[np.ndarray], list]


def no_detector(image: np.ndarray) -> list:
    return []


def safely_detected(detector: Detector, image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The detector's boxes as whole numbers; a failing detector finds nothing."""
    try:
        found = detector.detect(image) if hasattr(detector, "detect") else detector(image)
        return [tuple(int(v) for v in list(b)[:4]) for b in found if len(list(b)) >= 4]
    except Exception:  # plug-ins may raise anything
        return []


def tiles(embeddings: DataFrame) -> DataFrame:
    """Vectors of 64 numbers as 8 by 8 gray images: vec_id, label, pixels (row by row)."""
    level = lambda v: F.floor(F.lit(128.0) + (F.col("label") - 4) * 24 + v.cast("double") * (20 + 8 * F.col("label")))
    pixel = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), level(v))).cast("int"))
    return embeddings.filter(F.size("embedding") == TILE * TILE).select("vec_id", "label", pixel.alias("pixels"))


def _stack(column: pd.Series, zoom: int) -> np.ndarray:
    small = np.stack(column.to_numpy()).reshape(len(column), TILE, TILE) if len(column) else np.zeros((0, TILE, TILE), int)
    return small.repeat(zoom, axis=1).repeat(zoom, axis=2)


def _with_kernels(tiled: DataFrame, schema: str, zoom: int, kernel: Callable[[np.ndarray], dict]) -> DataFrame:
    """Adds what a kernel tells of the stack of a batch's tiles, in one pass."""
    keep = [f"{c} {t}" for c, t in tiled.dtypes if c != "pixels"]

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns="pixels").assign(**kernel(_stack(pdf["pixels"], zoom)))

    return tiled.mapInPandas(run, ", ".join(keep) + ", " + schema)


def _technical(stack: np.ndarray) -> dict:
    return pixels.technical(stack) | {"gradient": pixels.mean_squared_gradient(stack)}


def with_technical(tiled: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """Adds the technical scores of tiles; a batch is one stack."""
    return _with_kernels(tiled, _METRICS, zoom, _technical)


def with_body(tiled: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """Adds body scores over the central regions of tiles."""
    return _with_kernels(tiled, _BODY, zoom, pixels.body)


def with_technical_and_body(tiled: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """Adds both; the pixels go to Python once."""
    return _with_kernels(tiled, f"{_METRICS}, {_BODY}", zoom, lambda stack: _technical(stack) | pixels.body(stack))


def with_faces(tiled: DataFrame, boxes: list[tuple[int, int, int, int]], zoom: int = ZOOM) -> DataFrame:
    """Adds face scores of tiles for one list of boxes."""
    keep = [f"{c} {t}" for c, t in tiled.dtypes if c != "pixels"]

    def run(batches):
        for pdf in batches:
            found = pixels.faces(_stack(pdf["pixels"], zoom), boxes)
            yield pdf.drop(columns="pixels").assign(face_detected=found["face_count"] > 0, **found)

    return tiled.mapInPandas(run, ", ".join(keep) + ", " + _FACE)


def with_blurred_patches(tiled: DataFrame, zoom: int = ZOOM, threshold: float = 75.0, ratio: float = 0.25) -> DataFrame:
    """Adds the share of blurred cells of a 3 by 3 grid and whether that makes the tile locally blurred."""
    keep = [f"{c} {t}" for c, t in tiled.dtypes if c != "pixels"]

    def run(batches):
        for pdf in batches:
            share = pixels.blurred_patches(_stack(pdf["pixels"], zoom), threshold=threshold)
            yield pdf.drop(columns="pixels").assign(blurred_share=share, localized_blur=share >= ratio)

    return tiled.mapInPandas(run, ", ".join(keep) + ", blurred_share double, localized_blur boolean")


def neutral_face() -> dict[str, Column]:
    """Face columns while face analysis is off."""
    return {"face_detected": F.lit(False), "face_count": F.lit(0), "face_sharpness": F.lit(NEUTRAL), "face_score": F.lit(NEUTRAL)}


def neutral_body() -> dict[str, Column]:
    return {"person_detected": F.lit(False), "body_sharpness": F.lit(NEUTRAL), "body_blur_penalty": F.lit(0.0), "subject_score": F.lit(NEUTRAL)}


def analysed(images: DataFrame, preset: Preset, faces: Detector = no_detector, persons: Detector | None = None) -> DataFrame:
    """path, size, scores, hash and error per row of Spark's image source (image.origin, height, width, nChannels, data).

    An undecodable image gives an error row, never a failed task.
    """
    schema = f"path string, width int, height int, {_METRICS}, {_FACE}, {_BODY}, phash string, analysis_error string"
    blank = {"laplacian": 0.0, "brightness": 0.0, "sharpness": 0.0, "exposure": 0.0, "contrast": 0.0, "global_blur_penalty": 0.0, "gradient": 0.0,
             "face_detected": False, "face_count": 0, "face_sharpness": 0.0, "face_score": 0.0, "person_detected": False, "body_sharpness": 0.0, "body_blur_penalty": 0.0, "subject_score": 0.0, "phash": None}

    def one(row) -> dict:
        out = {"path": row.origin, "width": None, "height": None, "analysis_error": None, **blank}
        if row.height is None or row.height < 1:
            return out | {"analysis_error": "the file could not be decoded"}
        data = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
        gray = pixels.shrunk(pixels.to_gray(data[..., :3]).astype(np.uint8) if row.nChannels >= 3 else data[..., 0], preset.max_analysis_size)
        stack = gray[None]
        out |= {k: v[0] for k, v in pixels.technical(stack).items()}
        out |= {"width": row.width, "height": row.height, "gradient": pixels.mean_squared_gradient(stack)[0], "phash": pixels.perceptual_hash(gray)}
        found = safely_detected(faces, gray) if preset.face_analysis else []
        if preset.face_analysis:
            out |= {k: v[0] for k, v in pixels.faces(stack, found).items()} | {"face_detected": bool(found)}
        else:
            out |= {"face_sharpness": NEUTRAL, "face_score": NEUTRAL}
        if preset.body_analysis:
            out |= {k: v[0] for k, v in pixels.body(stack, safely_detected(persons, gray) if persons else None, found).items()}
        else:
            out |= {"body_sharpness": NEUTRAL, "subject_score": NEUTRAL}
        return out

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.itertuples()], columns=[c.split()[0] for c in schema.split(", ")])

    rows = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, schema)
    c = F.col
    scored = final_score(c("sharpness"), c("exposure"), c("contrast"), c("global_blur_penalty"), c("face_score"), c("body_sharpness"), c("body_blur_penalty"), c("subject_score"), score_mode(preset.mode))
    return rows.withColumn("technical_score", blended_technical(c("sharpness"), c("exposure"), c("contrast"))).withColumn(
        "final_score", F.when(c("analysis_error").isNull(), scored).otherwise(0.0)
    )


# What an item says of its analysis.
FAILED = "Analysis failed: "
FACE_SKIPPED = "Face analysis skipped by performance settings"
BODY_SKIPPED = "Body blur analysis skipped by performance settings"


def photo_records(analyses: DataFrame, files: DataFrame, preset: Preset, cached: DataFrame | None = None) -> DataFrame:
    """Whole items from `analysed` rows and their files (path, file_size, modified in epoch micros).

    Adds photo_id, file_name, cache_key, status (rejected where the analysis failed), the reasons, and the
    settings of the analysis; a failed item's id is its path.  cached: rows that the cache had for other files, added as hits.
    """
    failed = F.col("analysis_error").isNotNull()
    skipped = [t for t, on in ((FACE_SKIPPED, preset.face_analysis), (BODY_SKIPPED, preset.body_analysis)) if not on]
    none = F.array().cast("array<string>")
    settings = {
        "analysis_mode": preset.mode, "analysis_size": preset.max_analysis_size, "cache_version": preset.cache_version, "scoring_version": preset.scoring_version,
        "face_analysis_enabled": preset.face_analysis, "body_blur_analysis_enabled": preset.body_analysis, "copy_files_after_culling": preset.copy_files,
    }
    items = analyses.join(files.select("path", "file_size", "modified"), "path", "left").withColumns({
        "photo_id": F.when(failed, F.col("path")).otherwise(photo_id(F.col("path"), F.col("file_size"), F.col("modified"))),
        "file_name": file_name(F.col("path")), "cache_key": cache_key(F.col("path")), "status": F.when(failed, "rejected").otherwise("unprocessed"),
        "reasons": F.when(failed, F.array(F.concat(F.lit(FAILED), "analysis_error"))).otherwise(F.array(*[F.lit(t) for t in skipped]) if skipped else none), "cache_hit": F.lit(False),
        **{k: F.lit(v) for k, v in settings.items()},
    })
    if cached is None:
        return items
    hits = cached.withColumns({"file_name": file_name(F.col("path")), "status": F.coalesce("ai_status", F.lit("unprocessed")), "reasons": none, "cache_hit": F.lit(True)})
    return items.unionByName(hits.select(*[c for c in hits.columns if c in items.columns]), allowMissingColumns=True)


def cache_rows(records: DataFrame) -> DataFrame:
    """What a cache keeps of items, in the columns of the cache store; failed analyses stay out."""
    status = F.when(F.col("status") != "unprocessed", F.col("status"))
    good = records.filter("analysis_error is null").withColumn("ai_status", status)
    names = [c.split()[0] for c in CACHE.split(", ")]
    kinds = {c.split()[0]: c.split()[1] for c in CACHE.split(", ")}
    return good.select(*[(F.col(c) if c in good.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])


def perceptual_hashes(images: DataFrame, orientation: DataFrame | None = None) -> DataFrame:
    """path, phash (null where undecodable) of Spark's image source; orientation (path, orientation): images are turned upright first."""
    rows = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    rows = rows.withColumn("orientation", F.lit(1)) if orientation is None else rows.join(orientation.select("path", "orientation"), "path", "left")

    def one(r) -> str | None:
        if r.height is None or r.height < 1:
            return None
        data = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
        gray = pixels.to_gray(data[..., :3]).astype(np.uint8) if r.nChannels >= 3 else data[..., 0]
        return pixels.perceptual_hash(pixels.upright(gray, None if pd.isna(r.orientation) else int(r.orientation)))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "phash": [one(r) for r in pdf.itertuples()]})

    return rows.mapInPandas(run, "path string, phash string")


def path_groups(images: DataFrame, orientation: DataFrame | None = None, threshold: int = HASH_THRESHOLD, pattern: str = "CL%04d") -> DataFrame:
    """path, cluster_id, cluster_size, confidence: images hashed and grouped; unreadable ones stay alone."""
    hashed = written(perceptual_hashes(images, orientation))
    items = numbered(hashed, F.lower(file_name(F.col("path"))), F.col("path"), name="id").select("id", "path", unsigned_hex(F.col("phash")).alias("hash"))
    groups = labelled(grouped(items, threshold).withColumns({"name": file_name(F.col("path")), "seq": F.col("id")}), pattern)
    return groups.select("path", "cluster_id", "cluster_size", "confidence")


def face_count(detector: Detector, image: np.ndarray, widest: int = 900, least: int = 30) -> int:
    """Faces of at least `least` pixels in an image shrunk to a width; a failing detector finds none."""
    height, width = image.shape[:2]
    small = pixels.shrunk(image, max(1, int(max(height, width) * min(1.0, widest / max(1, width)))))
    return sum(1 for _, _, w, h in safely_detected(detector, small) if min(w, h) >= least)


def persons_of(model: Callable[[np.ndarray], list], kind: int = 0, least: float = 0.35) -> Detector:
    """A detector of boxes from a model whose rows are (class, confidence, left, top, right, bottom); without a model it finds nothing."""

    def detect(image: np.ndarray) -> list:
        found = model(image) if model is not None else []
        return [(x1, y1, x2 - x1, y2 - y1) for c, p, x1, y1, x2, y2 in found if c == kind and p >= least]

    return detect
