from __future__ import annotations

import numpy as np

from lumenpick.functions import pixels as p


def grid(size=120, step=6):
    image = np.zeros((size, size), np.uint8)
    image[:, ::step] = 255
    return image


def blurred(image, width=31):
    padded = np.pad(image.astype(float), width // 2, mode="reflect")
    line = np.ones(width) / width
    rows = np.apply_along_axis(lambda r: np.convolve(r, line, "valid"), 1, padded)
    return np.apply_along_axis(lambda c: np.convolve(c, line, "valid"), 0, rows).astype(np.uint8)


def test_sharp_images_score_above_blurred_ones():
    sharp, soft = (p.technical(x[None]) for x in (grid(), blurred(grid())))
    assert sharp["sharpness"][0] > soft["sharpness"][0]
    assert sharp["global_blur_penalty"][0] < soft["global_blur_penalty"][0]


def test_normal_exposure_beats_dark():
    normal, dark = (p.technical(np.full((1, 80, 80), v))["exposure"][0] for v in (128, 5))
    assert normal > 0.9 and dark < 0.2


def test_laplacian_matches_loops():
    image = np.random.default_rng(1).integers(0, 256, (7, 9))
    h, w = image.shape
    at = lambda r, c: int(image[abs(r) if r < h else 2 * h - 2 - r, abs(c) if c < w else 2 * w - 2 - c])
    lap = [at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c) for r in range(h) for c in range(w)]
    assert np.isclose(p.laplacian_variance(image[None])[0], np.var(lap))


def test_body_scores_follow_the_subject():
    image = np.full((160, 120), 120, np.uint8)
    image[55:145, 30:90] = grid(90)[:, :60]
    soft = image.copy()
    soft[55:145, 30:90] = blurred(grid(90))[:, :60]
    a, b = (p.body(x[None], faces=[(35, 15, 50, 35)]) for x in (image, soft))
    assert a["body_sharpness"][0] > b["body_sharpness"][0] and a["body_blur_penalty"][0] < b["body_blur_penalty"][0]
    assert p.body(np.zeros((1, 8, 8)))["person_detected"][0] == np.False_


def test_boxes_outside_and_small_are_dropped():
    assert p.clipped_box((200, 200, 10, 10), 80, 80) is None
    assert p.clipped_box((-5, -5, 50, 50), 80, 80) == (0, 0, 45, 45)
    assert p.clipped_box((0, 0, 7, 9), 80, 80) is None


def test_no_faces_is_neutral():
    out = p.faces(np.zeros((1, 64, 64)), [])
    assert (out["face_count"][0], out["face_sharpness"][0], out["face_score"][0]) == (0, 0.0, 0.45)


def test_resizing():
    assert p.shrunk(np.zeros((400, 600), np.uint8), 300).shape == (200, 300)
    assert p.shrunk(np.zeros((80, 120, 3), np.uint8), 300).shape == (80, 120, 3)
    assert p.shrunk(np.full((400, 600, 3), 9, np.uint8), 100).tolist() == np.full((67, 100, 3), 9).tolist()


def test_hashes_of_copies_agree_and_of_others_differ():
    rng = np.random.default_rng(3)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((12, 12))).astype(np.uint8)
    noisy = np.clip(image.astype(int) + rng.integers(-2, 3, image.shape), 0, 255)
    distance = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert p.perceptual_hash(image) == p.perceptual_hash(image.copy())
    assert distance(p.perceptual_hash(image), p.perceptual_hash(noisy)) <= 8
    assert distance(p.perceptual_hash(image), p.perceptual_hash(image[:, ::-1])) > 8


def test_patches():
    assert p.blurred_patches(grid(90)[None])[0] == 0
    assert p.blurred_patches(np.full((1, 90, 90), 7))[0] == 1
