"""Small copies of images, made once per image key."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jpeg import encoded_jpeg
from ..functions.pixels import shrunk, upright

MAX_WIDTH, MAX_HEIGHT = 360, 270
#: JPEG quality.
QUALITY = 82


def thumbnail(image: np.ndarray) -> np.ndarray:
    """At most MAX_WIDTH by MAX_HEIGHT, never enlarged."""
    height, width = image.shape[:2]
    scale = min(1.0, MAX_WIDTH / width, MAX_HEIGHT / height)
    return shrunk(image, max(1, int(max(height, width) * scale)))


def write_thumbnails(images: DataFrame, folder: str, existing: DataFrame | None = None, orientation: DataFrame | None = None) -> DataFrame:
    """path, thumbnail_path, error per row of Spark's image source whose thumbnail does not exist yet.

    orientation (path, orientation): images are turned upright as their EXIF data say.

    They are JPEG files.  Files appear under their final name only when complete, so a retried task is harmless.
    """
    todo = images.select(F.col("image.origin").alias("path"), F.concat(F.lit(folder.rstrip("/") + "/"), F.sha1("image.origin"), F.lit(".jpg")).alias("thumbnail_path"), "image.height", "image.width", "image.nChannels", "image.data")
    todo = todo.withColumn("orientation", F.lit(1)) if orientation is None else todo.join(orientation.select("path", "orientation"), "path", "left")
    if existing is not None:
        todo = todo.join(existing.select("thumbnail_path").distinct(), "thumbnail_path", "left_anti")

    def run(batches):
        for pdf in batches:
            errors = []
            for row in pdf.itertuples():
                try:
                    data = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                    turned = upright(data, None if pd.isna(row.orientation) else int(row.orientation))
                    small = thumbnail(turned[..., 2::-1] if row.nChannels >= 3 else turned[..., 0])
                    os.makedirs(os.path.dirname(row.thumbnail_path), exist_ok=True)
                    part = f"{row.thumbnail_path}.{uuid.uuid4().hex}"
                    with open(part, "wb") as handle:
                        handle.write(encoded_jpeg(small, QUALITY))
                    os.replace(part, row.thumbnail_path)
                    errors.append(None)
                except (OSError, ValueError, ZeroDivisionError) as e:
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"path": pdf["path"], "thumbnail_path": pdf["thumbnail_path"], "error": errors})

    return todo.mapInPandas(run, "path string, thumbnail_path string, error string")
