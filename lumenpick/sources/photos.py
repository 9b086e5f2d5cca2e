"""Reading images and their metadata."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import struct
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IMAGE_SUFFIXES
from ..functions.scalars import suffix
from ..plans.storage import Scratch
from .files import files_below, hidden, place

METADATA = "camera string, lens string, iso int, aperture string, shutter_speed string, focal_length string, date_taken string"
# TIFF tag numbers.
_ORIENTATION = 0x0112
_MAKE, _MODEL, _DATE, _EXIF, _EXPOSURE, _APERTURE, _ISO, _TAKEN, _FOCAL, _LENS = 0x010F, 0x0110, 0x0132, 0x8769, 0x829A, 0x829D, 0x8827, 0x9003, 0x920A, 0xA434


def decoded(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Spark's image source: struct `image` with blue-green-red bytes; undecodable files keep a row with height -1.

    That source leaves out files whose names begin with _ or ., as cameras write them.  They are
    linked under plain names in the shared folder, read there, and appear under their own paths.
    """
    paths = [paths] if isinstance(paths, str) else paths
    named = [p for p in paths if hidden(p.rstrip("/").rsplit("/", 1)[-1]) and place(p)[0] is None and os.path.isfile(place(p)[1])]
    rest = [p for p in paths if p not in named]
    found = [spark.read.format("image").option("dropInvalid", False).load(rest)] if rest else []
    unseen = reduce(DataFrame.unionByName, [files_below(spark, p, recursive=False) for p in paths])
    unseen = unseen.filter(F.rlike("file_name", F.lit("^[_.]")) & F.lower(suffix(F.col("file_name"))).isin(*IMAGE_SUFFIXES))
    staged = _staged(spark, unseen.select("path"))
    if staged is not None:
        found.append(staged)
    return reduce(DataFrame.unionByName, found) if found else spark.read.format("image").load([]).limit(0)


def _staged(spark: SparkSession, unseen: DataFrame) -> DataFrame | None:
    """Files under other names in a folder of their own; None where there are none."""
    scratch = Scratch(spark)
    folder = re.sub("^file:/*", "/", scratch.root) + "/staged"

    def link(batches):
        for pdf in batches:
            os.makedirs(folder, exist_ok=True)
            names = [f"{folder}/{hashlib.sha1(p.encode()).hexdigest()}{os.path.splitext(p.lstrip('_.'))[1]}" for p in pdf["path"]]
            for path, name in zip(pdf["path"], names, strict=True):
                if not os.path.lexists(name):
                    try:
                        os.link(path, name)
                    except FileExistsError:  # a retried task
                        pass
                    except OSError:  # another device
                        part = f"{name}.{uuid.uuid4().hex}"
                        shutil.copy2(path, part)
                        os.replace(part, name)
            yield pdf.assign(name=names)

    names = scratch.keep(unseen.mapInPandas(link, "path string, name string"))
    if names.isEmpty():
        return None
    images = spark.read.format("image").option("dropInvalid", False).load(folder)
    own = images.join(names, F.element_at(F.split("image.origin", "/"), -1) == F.element_at(F.split("name", "/"), -1))
    return own.select(F.col("image").withField("origin", F.concat(F.lit("file://"), "path")).alias("image"))


def sizes(images: DataFrame) -> DataFrame:
    """path, width, height; null where a file can't be read."""
    ok = F.col("image.height") > 0
    return images.select(F.col("image.origin").alias("path"), F.when(ok, F.col("image.width")).alias("width"), F.when(ok, F.col("image.height")).alias("height"))


def _directory(data: bytes, at: int, order: str) -> dict:
    """Tags of one image file directory."""
    out = {}
    (count,) = struct.unpack_from(order + "H", data, at)
    widths = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = widths.get(kind, 0) * n
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        raw = data[where : where + size]
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (3, 4) and len(raw) == size and n:
            out[tag] = struct.unpack(order + {3: "H", 4: "I"}[kind] * n, raw)[0]
        elif kind in (5, 10) and len(raw) == size and n:
            out[tag] = "{}/{}".format(*struct.unpack(order + {5: "II", 10: "ii"}[kind], raw[:8]))
    return out


def _first_directory(data: bytes) -> tuple[dict, bytes, str]:
    """The tags of the first directory, the TIFF part and its byte order; KeyError without one."""
    start = data.find(b"Exif\0\0")
    if start < 0:
        raise KeyError("Exif")
    tiff = data[start + 6 :]
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]
    return _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order), tiff, order


def orientation(data: bytes) -> int:
    """EXIF orientation, 1 where it is absent, unreadable or out of range."""
    try:
        found = _first_directory(data)[0].get(_ORIENTATION, 1)
        return found if found in range(1, 9) else 1
    except (KeyError, struct.error, IndexError):
        return 1


def exif(data: bytes) -> dict:
    """Camera metadata of a JPEG; every field is None where it is absent or unreadable."""
    out = dict.fromkeys(c.split()[0] for c in METADATA.split(", "))
    try:
        tags, tiff, order = _first_directory(data)
        more = _directory(tiff, tags[_EXIF], order) if _EXIF in tags else {}
        out["camera"] = " ".join(x for x in (tags.get(_MAKE), tags.get(_MODEL)) if x) or None
        out |= {"lens": more.get(_LENS), "iso": more.get(_ISO), "aperture": more.get(_APERTURE), "shutter_speed": more.get(_EXPOSURE), "focal_length": more.get(_FOCAL), "date_taken": more.get(_TAKEN) or tags.get(_DATE)}
    except (KeyError, struct.error, IndexError):
        pass
    return out


def with_metadata(files: DataFrame) -> DataFrame:
    """path and camera metadata of Spark's binaryFile rows (path, content)."""

    def run(batches):
        for pdf in batches:
            rows = pd.DataFrame([exif(bytes(c)) for c in pdf["content"]], columns=[c.split()[0] for c in METADATA.split(", ")])
            yield pd.concat([pdf[["path"]].reset_index(drop=True), rows.astype({"iso": "Int32"})], axis=1)

    return files.select("path", "content").mapInPandas(run, "path string, " + METADATA)


def orientations(files: DataFrame) -> DataFrame:
    """path, orientation of rows (path, content) of binary_files or of Spark's binaryFile source."""

    def run(batches):
        for pdf in batches:
            yield pdf[["path"]].assign(orientation=[orientation(bytes(c)) for c in pdf["content"]])

    return files.select("path", "content").mapInPandas(run, "path string, orientation int")


def photo_items(files: DataFrame, images: DataFrame) -> DataFrame:
    """One row per file: path, file_name, file_size, modified (epoch micros), created_at, width, height and the camera metadata.

    files: Spark's binaryFile rows; images: Spark's image source of the same files.  created_at is the date taken, else the file's time.
    """
    base = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.unix_micros("modificationTime").alias("modified"))
    joined = base.join(with_metadata(files), "path", "left").join(sizes(images), "path", "left")
    return joined.withColumn("created_at", F.coalesce(F.try_to_timestamp("date_taken", F.lit("yyyy:MM:dd HH:mm:ss")), F.timestamp_micros("modified")))
