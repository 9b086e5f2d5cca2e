"""Image kernels on stacks of equally large gray images (numpy, whole Arrow batches at once).

Sums are kept in whole numbers and divided once, so results do not depend on order.
"""

from __future__ import annotations

import numpy as np

LAPLACIAN_REFERENCE = 300.0
REGION_REFERENCE = 220.0
GRADIENT_REFERENCE = 9000.0
BRIGHT, DARK = 245, 10


def to_gray(bgr: np.ndarray) -> np.ndarray:
    """Blue-green-red bytes to gray bytes, rounded."""
    b, g, r = (bgr[..., i].astype(float) for i in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).astype(np.int64)


def _mirrored(stack: np.ndarray) -> np.ndarray:
    """A border of one pixel that repeats the second row or column, or the only one."""
    mode = {1: "edge"}
    out = np.pad(stack, ((0, 0), (1, 1), (0, 0)), mode=mode.get(stack.shape[1], "reflect"))
    return np.pad(out, ((0, 0), (0, 0), (1, 1)), mode=mode.get(stack.shape[2], "reflect"))


def laplacian_variance(stack: np.ndarray) -> np.ndarray:
    """Population variance of the four-neighbour Laplacian."""
    if 0 in stack.shape[1:]:
        return np.zeros(len(stack))
    p = _mirrored(stack.astype(np.int64))
    lap = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * p[:, 1:-1, 1:-1]
    n = lap.shape[1] * lap.shape[2]
    total, squares = lap.sum(axis=(1, 2)), (lap * lap).sum(axis=(1, 2))
    return (n * squares - total * total) / float(n * n)


def mean_squared_gradient(stack: np.ndarray) -> np.ndarray:
    """Mean of the squared Sobel gradient."""
    if 0 in stack.shape[1:]:
        return np.zeros(len(stack))
    p = _mirrored(stack.astype(np.int64))
    across = p[:, :, 2:] - p[:, :, :-2]
    down = p[:, 2:, :] - p[:, :-2, :]
    gx = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]
    gy = down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]
    return (gx * gx + gy * gy).sum(axis=(1, 2)) / float(gx.shape[1] * gx.shape[2])


def clamp01(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10000.0 + 0.5) / 10000.0


def technical(stack: np.ndarray) -> dict[str, np.ndarray]:
    """Raw Laplacian variance, brightness, and the four rounded technical scores."""
    n = stack.shape[1] * stack.shape[2]
    flat = stack.reshape(len(stack), n).astype(np.int64)
    total, squares = flat.sum(axis=1), (flat * flat).sum(axis=1)
    mean = total / float(n)
    spread = np.sqrt((n * squares - total * total) / float(n * n))
    clipped = (flat >= BRIGHT).sum(axis=1) / float(n) + (flat <= DARK).sum(axis=1) / float(n)
    raw = laplacian_variance(stack)
    sharpness = clamp01(raw / LAPLACIAN_REFERENCE)
    exposure = clamp01(1.0 - np.minimum(np.abs(mean - 128.0) / 128.0, 1.0) - 0.5 * clipped)
    return {
        "laplacian": raw, "brightness": mean, "sharpness": rounded(sharpness), "exposure": rounded(exposure),
        "contrast": rounded(clamp01(spread / 80.0)), "global_blur_penalty": rounded(clamp01(1.0 - sharpness)),
    }


def central_regions(width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Where a subject is likely: three boxes (x, y, w, h) as shares of the image."""
    # Fixed values.
    shares = ((0.20, 0.34, 0.60, 0.58), (0.28, 0.40, 0.44, 0.48), (0.12, 0.46, 0.76, 0.38))
    return [(int(width * x), int(height * y), int(width * w), int(height * h)) for x, y, w, h in shares]


def clipped_box(box, width: int, height: int, least_share: float = 0.01, least_pixels: int = 64):
    """The part of a box inside the image, or None if that is too small."""
    x, y, w, h = (int(v) for v in box)
    x1, y1, x2, y2 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
    if x2 <= x1 or y2 <= y1 or (x2 - x1) * (y2 - y1) < max(least_pixels, width * height * least_share):
        return None
    return x1, y1, x2 - x1, y2 - y1


def region_sharpness(stack: np.ndarray) -> np.ndarray:
    return rounded(clamp01(0.65 * clamp01(laplacian_variance(stack) / REGION_REFERENCE) + 0.35 * clamp01(mean_squared_gradient(stack) / GRADIENT_REFERENCE)))


def combined(scores: np.ndarray) -> np.ndarray:
    """Of scores per image and region: nothing, the only one, or mostly the best with some median."""
    if scores.shape[1] == 0:
        return np.zeros(len(scores))
    if scores.shape[1] == 1:
        return scores[:, 0]
    return rounded(clamp01(0.7 * scores.max(axis=1) + 0.3 * np.median(scores, axis=1)))


def body(stack: np.ndarray, boxes=None, faces=None) -> dict[str, np.ndarray]:
    """Body sharpness, blur penalty and subject score over boxes, or the central regions where no box is usable; faces blacked out."""
    height, width = stack.shape[1:]
    if not width or not height:
        zero = np.zeros(len(stack))
        return {"person_detected": zero.astype(bool), "body_sharpness": zero, "body_blur_penalty": zero, "subject_score": zero}
    usable = lambda some: [r for r in (clipped_box(b, width, height) for b in some) if r]
    regions = usable(boxes or ()) or usable(central_regions(width, height))
    stack = stack.copy()
    for x, y, w, h in faces or ():
        stack[:, max(0, y) : max(0, y + h + 1), max(0, x) : max(0, x + w + 1)] = 0
    scores = np.stack([region_sharpness(stack[:, y : y + h, x : x + w]) for x, y, w, h in regions], axis=1) if regions else np.zeros((len(stack), 0))
    sharp = combined(scores)
    found = np.full(len(stack), bool(regions))
    penalty = rounded(1.0 - sharp)
    subject = rounded(clamp01(0.85 * sharp + 0.15 * (1.0 - penalty)))
    return {"person_detected": found, "body_sharpness": sharp, "body_blur_penalty": penalty, "subject_score": subject}


def faces(stack: np.ndarray, boxes) -> dict[str, np.ndarray]:
    """Face count, sharpness and score for one list of boxes; without boxes the score is neutral, and boxes off the image count but have no sharpness."""
    height, width = stack.shape[1:]
    zero = np.zeros(len(stack))
    if not len(boxes):
        return {"face_count": zero.astype(int), "face_sharpness": zero, "face_score": zero + 0.45}
    crops = [r for r in (clipped_box(b, width, height, 0, 1) for b in boxes) if r]
    sharp = np.max([zero, *[clamp01(laplacian_variance(stack[:, y : y + h, x : x + w]) / REGION_REFERENCE) for x, y, w, h in crops]], axis=0)
    return {"face_count": np.full(len(stack), len(boxes)), "face_sharpness": rounded(sharp), "face_score": rounded(clamp01(0.75 * sharp + 0.06 * min(len(boxes), 4)))}


def blurred_patches(stack: np.ndarray, rows: int = 3, cols: int = 3, threshold: float = 75.0) -> np.ndarray:
    """Share of the cells of a grid whose Laplacian variance is below the threshold."""
    height, width = stack.shape[1:]
    cells = [stack[:, r * height // rows : (r + 1) * height // rows, c * width // cols : (c + 1) * width // cols] for r in range(rows) for c in range(cols)]
    cells = [c for c in cells if 0 not in c.shape[1:]]
    return np.mean([laplacian_variance(c) < threshold for c in cells], axis=0) if cells else np.zeros(len(stack))


def upright(image: np.ndarray, orientation: int | None) -> np.ndarray:
    """An image turned as its EXIF orientation (1 to 8) says; other values leave it as it is."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    return image


def shrunk(image: np.ndarray, longest: int) -> np.ndarray:
    """Area-averaged copy whose longest side fits; smaller images stay as they are."""
    height, width = image.shape[:2]
    if longest <= 0 or max(height, width) <= longest:
        return image
    scale = longest / max(height, width)
    rows, cols = max(1, round(height * scale)), max(1, round(width * scale))
    return np.floor(_area_weights(height, rows) @ np.moveaxis(image.astype(float), -1, 0 if image.ndim == 3 else -1) @ _area_weights(width, cols).T + 0.5).astype(np.uint8).transpose(*((1, 2, 0) if image.ndim == 3 else (0, 1)))


def _area_weights(size: int, parts: int) -> np.ndarray:
    """How much of each of `size` pixels falls in each of `parts` equal shares."""
    edges = np.linspace(0, size, parts + 1)
    low, high = np.arange(size), np.arange(1, size + 1)
    cover = np.clip(np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def _sinc_weights(size: int, parts: int, lobes: int = 3) -> np.ndarray:
    """Row i: the weights of `size` pixels in pixel i of `parts`, a windowed sinc that widens where pixels become fewer."""
    scale = size / parts
    wide = max(scale, 1.0)
    at = (np.arange(size)[None, :] + 0.5 - (np.arange(parts)[:, None] + 0.5) * scale) / wide
    weights = np.where(np.abs(at) < lobes, np.sinc(at) * np.sinc(at / lobes), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resampled(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """A gray image of other size by a windowed sinc, rows after columns, each pass rounded to 0 to 255."""
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    return level(_sinc_weights(gray.shape[0], rows) @ level(gray.astype(float) @ _sinc_weights(gray.shape[1], cols).T)).astype(np.uint8)


def perceptual_hash(gray: np.ndarray) -> str:
    """Sixteen hex digits: which low cosine coefficients of the resampled 32 by 32 image exceed their median."""
    small = resampled(gray, 32, 32).astype(float)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"
