"""The cascade detector against a plain loop, its grouping, and the table function."""

from __future__ import annotations

import json

import numpy as np

from lumenpick.functions import pixels
from lumenpick.operators import detection, images
from lumenpick.plans.fixtures import CASCADE

#: Bright squares on a dark ground: the middle of a 6 by 6 window against its border.
SQUARES = json.dumps({"width": 6, "height": 6, "stages": [
    {"threshold": 1.0, "stumps": [{"rects": [[1, 1, 4, 4, 1.0], [0, 0, 6, 6, -1.0]], "threshold": 0.55, "left": 0.0, "right": 1.0}]},
    {"threshold": 1.5, "stumps": [{"rects": [[1, 1, 2, 4, 1.0], [3, 1, 2, 4, -1.0]], "threshold": 0.2, "left": 1.0, "right": 0.0}, {"rects": [[3, 1, 2, 4, 1.0], [1, 1, 2, 4, -1.0]], "threshold": 0.2, "left": 1.0, "right": 0.0}]},
]})


def plain_windows(image, text):
    model, out, scale = json.loads(text), [], 1.0
    while True:
        h, w = round(model["height"] * scale), round(model["width"] * scale)
        if h > image.shape[0] or w > image.shape[1]:
            return out
        hop = max(1, round(scale))
        for y in range(0, image.shape[0] - h + 1, hop):
            for x in range(0, image.shape[1] - w + 1, hop):
                part = image[y : y + h, x : x + w].astype(float)
                ok = True
                for stage in model["stages"]:
                    total = 0.0
                    for stump in stage["stumps"]:
                        value = 0.0
                        for rx, ry, rw, rh, weight in stump["rects"]:
                            rows, columns = max(1, round(rh * scale)), max(1, round(rw * scale))
                            top, left = min(round(ry * scale), h - rows), min(round(rx * scale), w - columns)
                            value += weight * part[top : top + rows, left : left + columns].mean()
                        total += stump["left"] if value < stump["threshold"] * part.std() else stump["right"]
                    ok = total >= stage["threshold"]
                    if not ok:
                        break
                if ok:
                    out.append((x, y, w, h))
        scale *= detection.SCALE_STEP


def planted():
    image = np.random.default_rng(1).integers(20, 40, (48, 64))
    for x, y, n in ((5, 6, 4), (30, 10, 8), (44, 28, 12)):
        image[y : y + n, x : x + n] += 180
    return image


def test_windows_equal_a_plain_loop():
    image = planted()
    assert detection.Cascade(SQUARES).windows(image) == plain_windows(image, SQUARES)
    noise = np.random.default_rng(2).integers(0, 256, (30, 41))
    assert detection.Cascade(CASCADE).windows(noise) == plain_windows(noise, CASCADE) != []
    assert detection.Cascade(SQUARES).windows(np.zeros((3, 3))) == []


def test_planted_squares_are_found_once_each():
    found = detection.Cascade(SQUARES, neighbours=1).detect(planted())
    for x, y, n in ((30, 10, 8), (44, 28, 12)):
        assert any(abs(bx + bw / 2 - x - n / 2) <= n / 3 and abs(by + bh / 2 - y - n / 2) <= n / 3 and n * 0.8 <= bw <= n * 2.2 for bx, by, bw, bh in found), (x, y, n, found)
    assert len(found) <= 6 and detection.Cascade(SQUARES, neighbours=1).detect(np.full((48, 64), 30)) == []


def test_groups_of_boxes():
    boxes = [(10, 10, 20, 20), (11, 10, 20, 20), (10, 12, 21, 20), (60, 60, 20, 20), (12, 11, 20, 22)]
    assert detection.grouped_boxes(boxes, 3) == [(11, 11, 20, 21)] and detection.grouped_boxes(boxes, 0) == boxes
    assert detection.grouped_boxes(boxes, 4) == [] and detection.grouped_boxes([], 3) == []


def test_cascades_plug_into_the_analysis():
    count = images.face_count(detection.Cascade(SQUARES, neighbours=1), planted(), least=6)
    assert count >= 2


def test_boxes_are_joined_laterally(spark):
    image = planted()
    rows = [(1, image.ravel().tolist(), "a"), (2, np.full(48 * 64, 9).tolist(), "b"), (3, None, "c"), (4, [], "d")]
    df = spark.createDataFrame(rows, "id long, pixels array<int>, x0 string")
    found = detection.boxes(df, SQUARES, 64, neighbours=1)
    want = detection.Cascade(SQUARES, neighbours=1).detect(image)
    assert sorted((r.id, r.x, r.y, r.w, r.h) for r in found.collect()) == sorted((1, *b) for b in want) and found.columns == ["id", "x0", "x", "y", "w", "h"]
    scored = {r.id: r for r in detection.faces_in_boxes(df.filter("id < 3"), found.select("id", "x", "y", "w", "h"), "id", 64).collect()}
    ordered = sorted(want, key=lambda b: (b[1], b[0], b[2], b[3]))
    direct = {k: v[0] for k, v in pixels.faces(image[None], ordered).items()}
    assert scored[1].face_count == direct["face_count"] == len(want) and abs(scored[1].face_score - direct["face_score"]) < 1e-12 and not scored[2].face_detected
