"""Boxes in images: a boosted cascade evaluated over integral images, as a detector and as a table function.

A cascade is given as a JSON text and trained elsewhere:
{"width": w, "height": h, "stages": [{"threshold": t, "stumps": [{"rects": [[x, y, w, h, weight], ...], "threshold": t, "left": a, "right": b}]}]}.
A window passes a stage if its stumps' values reach the stage's threshold; a stump gives `left` if its
weighted mean over rectangles lies below its threshold times the window's standard deviation, else `right`.
Windows of all places of a scale go through the stages together, and only those that passed go on.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels

SCALE_STEP = 1.25


def integral(image: np.ndarray) -> np.ndarray:
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    out[1:, 1:] = image.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    return out


def _sums(table: np.ndarray, y: np.ndarray, x: np.ndarray, h: int, w: int) -> np.ndarray:
    return table[y + h, x + w] - table[y, x + w] - table[y + h, x] + table[y, x]


class Cascade:
    """A detector: detect(image) gives boxes (x, y, w, h) of a gray image."""

    def __init__(self, text: str, step: float = SCALE_STEP, neighbours: int = 3, largest: float | None = None):
        self.model = json.loads(text)
        self.step, self.neighbours, self.largest = step, neighbours, largest

    def windows(self, image: np.ndarray) -> list[tuple[int, int, int, int]]:
        """All windows that pass every stage, by scale, row and column."""
        height, width = image.shape
        sums, squares = integral(image), integral(image.astype(np.int64) ** 2)
        out, scale = [], 1.0
        while True:
            h, w = round(self.model["height"] * scale), round(self.model["width"] * scale)
            if h > height or w > width or (self.largest is not None and scale > self.largest):
                return out
            hop = max(1, round(scale))
            y, x = (g.ravel() for g in np.meshgrid(np.arange(0, height - h + 1, hop), np.arange(0, width - w + 1, hop), indexing="ij"))
            mean = _sums(sums, y, x, h, w) / (h * w)
            spread = np.sqrt(np.maximum(_sums(squares, y, x, h, w) / (h * w) - mean * mean, 0))
            for stage in self.model["stages"]:
                total = np.zeros(len(y))
                for stump in stage["stumps"]:
                    value = np.zeros(len(y))
                    for rx, ry, rw, rh, weight in stump["rects"]:
                        rows, columns = max(1, round(rh * scale)), max(1, round(rw * scale))
                        top, left = min(round(ry * scale), h - rows), min(round(rx * scale), w - columns)
                        value = value + weight * (_sums(sums, y + top, x + left, rows, columns) / (rows * columns))
                    total = total + np.where(value < stump["threshold"] * spread, stump["left"], stump["right"])
                passed = total >= stage["threshold"]
                y, x, spread = y[passed], x[passed], spread[passed]
                if not len(y):
                    break
            out += [(int(a), int(b), w, h) for b, a in zip(y, x, strict=True)]
            scale *= self.step

    def detect(self, image: np.ndarray) -> list[tuple[int, int, int, int]]:
        return grouped_boxes(self.windows(image), self.neighbours)


def grouped_boxes(boxes: list[tuple[int, int, int, int]], neighbours: int, near: float = 0.2) -> list[tuple[int, int, int, int]]:
    """Means of the groups of alike boxes that have more than `neighbours` members; with 0 the boxes as they are."""
    if neighbours <= 0 or not boxes:
        return boxes
    b = np.array(boxes, float)
    reach = near * (np.minimum(b[:, None, 2], b[None, :, 2]) + np.minimum(b[:, None, 3], b[None, :, 3])) / 2
    edges = np.stack([b[:, 0], b[:, 1], b[:, 0] + b[:, 2], b[:, 1] + b[:, 3]], axis=1)
    alike = (np.abs(edges[:, None] - edges[None, :]) <= reach[..., None]).all(axis=2)
    group = np.arange(len(b))
    while True:  # every box takes the least group among its likes
        least = np.where(alike, group[None, :], len(b)).min(axis=1)
        if (least == group).all():
            break
        group = least
    out = []
    for g in np.unique(group):
        members = b[group == g]
        if len(members) > neighbours:
            out.append(tuple(int(np.floor(v + 0.5)) for v in members.mean(axis=0)))
    return out


@functools.lru_cache(maxsize=16)
def _cascade(text: str, neighbours: int, largest: float) -> Cascade:
    return Cascade(text, neighbours=neighbours, largest=largest)


@F.udtf(returnType="x int, y int, w int, h int")
class Boxes:
    """boxes(pixels, width, cascade, neighbours, largest): the boxes of one gray image, a row each."""

    def eval(self, values: list, width: int, cascade: str, neighbours: int, largest: float):
        if values and width and len(values) % width == 0:
            yield from _cascade(cascade, neighbours, largest).detect(np.array(values).reshape(-1, width))


def boxes(images: DataFrame, cascade: str, width: int, neighbours: int = 3, largest: float = 1e9) -> DataFrame:
    """images (with a column pixels, row by row) joined laterally with their boxes: x, y, w, h; images without boxes have no row."""
    found = Boxes(F.col("pixels").outer(), F.lit(width), F.lit(cascade), F.lit(neighbours), F.lit(float(largest)))
    return images.lateralJoin(found).drop("pixels")


def faces_in_boxes(images: DataFrame, found: DataFrame, key: str, width: int) -> DataFrame:
    """images with face scores over their own boxes (key, x, y, w, h), as many as a detector gives for one image."""
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "x", "w", "h"))).alias("_boxes"))
    rows = images.join(lists, key, "left")
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("pixels", "_boxes")]

    def run(batches):
        for pdf in batches:
            out = []
            for values, own in zip(pdf["pixels"], pdf["_boxes"], strict=True):
                stack = np.asarray(values).reshape(1, -1, width)
                at = [(b["x"], b["y"], b["w"], b["h"]) for b in own] if own is not None else []
                out.append({k: v[0] for k, v in pixels.faces(stack, at).items()})
            more = pd.DataFrame(out, columns=["face_count", "face_sharpness", "face_score"], index=pdf.index)
            yield pdf.drop(columns=["pixels", "_boxes"]).assign(face_detected=more["face_count"] > 0, **more)

    return rows.mapInPandas(run, ", ".join(keep) + ", face_detected boolean, face_count int, face_sharpness double, face_score double")
