"""Quality scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_PENALTY_WEIGHTS, NEUTRAL, PENALTY_WEIGHTS
from ..functions.scalars import clamp01, compact, num, rounded


def final_score(sharpness: Column, exposure: Column, contrast: Column, global_blur: Column, face: Column, body_sharpness: Column, body_blur: Column, subject: Column, mode: str) -> Column:
    """The score that ranks images; the body part falls back to sharpness less blur where no subject score is known."""
    body_weight = 0.30 if mode in ("balanced", "aggressive") else 0.25
    global_weight, blur_weight = PENALTY_WEIGHTS.get(mode, DEFAULT_PENALTY_WEIGHTS)
    fallback = (subject == 0.0) & ((body_sharpness != 0.0) | (body_blur != 0.0))
    body = F.when(fallback, clamp01(body_sharpness - num(0.35) * body_blur)).otherwise(subject)
    total = (
        num(0.30) * sharpness + num(0.20) * exposure + num(0.10) * contrast + num(0.3) * face + num(body_weight) * body
        - num(global_weight) * global_blur - num(blur_weight) * body_blur
    )
    return rounded(clamp01(total))


def blended_technical(sharpness: Column, exposure: Column, contrast: Column) -> Column:
    return rounded(clamp01(num(0.5) * sharpness + num(0.3) * exposure + num(0.2) * contrast))


def weighted_final(technical: Column, face: Column, body: Column, aesthetic: Column, penalty: Column) -> Column:
    """The earlier final score with an aesthetic part, which counts less for blurred subjects."""
    face, body = F.coalesce(face, num(NEUTRAL)), F.coalesce(body, num(NEUTRAL))
    aesthetic, penalty = F.coalesce(aesthetic, num(0.5)), F.coalesce(penalty, num(0))
    weight = F.when(penalty > 0.35, num(0.03)).otherwise(num(0.1))
    return rounded(clamp01(num(0.3) * technical + num(0.3) * face + num(0.25) * body + weight * aesthetic - num(0.2) * penalty))


def aesthetic_score(scorer: Callable[..., Column] | None = None, *inputs: Column) -> Column:
    """A model's score of the inputs (any function of columns, a pandas UDF for instance), bounded to 0..1; neutral without a model or a score."""
    if scorer is None:
        return num(0.5)
    score = scorer(*inputs)
    return F.when(score.isNotNull(), clamp01(score)).otherwise(num(0.5))


def blur_penalty(score: Column, threshold: float = 0.45) -> Column:
    return F.when(score >= threshold, num(0)).otherwise(clamp01((num(threshold) - score) / num(threshold)))


def technical_with_penalty(sharpness: Column, exposure: Column, contrast: Column) -> Column:
    return rounded(clamp01(num(0.5) * sharpness + num(0.3) * exposure + num(0.2) * contrast - blur_penalty(sharpness)))


def counted_face_score(faces: Column) -> Column:
    return F.when(faces > 0, F.least(num(1), num(0.35) + num(0.25) * faces)).otherwise(num(NEUTRAL))


def body_from_raw(main_blur: Column, localized: Column) -> tuple[Column, Column]:
    """Body sharpness and blur penalty from a raw region sharpness."""
    sharp = F.when(main_blur.isNull(), num(NEUTRAL)).otherwise(clamp01(main_blur / num(180)))
    return sharp, F.when(localized, num(0.35)).otherwise(F.greatest(num(0), num(0.45) - sharp))


def point_score(blurry: Column, under: Column, over: Column, has_face: Column, duplicate: Column, best: Column) -> Column:
    """Points out of a hundred and some: penalties and bonuses of the first generation."""
    flag = lambda c, yes, no=0: F.when(c, F.lit(yes)).otherwise(F.lit(no))
    return (
        F.lit(100) + flag(blurry, -40) + flag(under | over, -25) + flag(has_face, 15, -10) + flag(duplicate & ~best, -30) + flag(duplicate & best, 10)
    ).cast("int")


def point_status(points: Column, selected_from: float = 80, review_from: float = 50) -> Column:
    return F.when(points >= selected_from, "SELECTED").when(points >= review_from, "REVIEW").otherwise("REJECTED")


def human_quality(has_face: Column, global_blur: Column, main: Column, average: Column, localized: Column, exposure_class: Column) -> Column:
    """0 to 150, by bands of raw sharpness."""
    band = lambda c, steps, least: F.coalesce(*[F.when(c >= edge, F.lit(points)) for edge, points in steps], F.lit(least))
    total = (
        F.lit(100) + F.when(has_face, F.lit(20)).otherwise(F.lit(-15)) + band(global_blur, ((180, 10), (100, 0), (50, -25)), -60)
        + F.when(main.isNull(), F.lit(-10)).otherwise(band(main, ((150, 25), (100, 10), (60, -25)), -50))
        + F.when(average.isNull(), F.lit(0)).otherwise(band(average, ((130, 10), (80, 0)), -20))
        + F.when(localized, F.lit(-35)).otherwise(F.lit(0)) + F.when(exposure_class == "NORMAL", F.lit(0)).otherwise(F.lit(-15))
    )
    return F.greatest(F.lit(0), F.least(F.lit(150), total)).cast("int")


def exposure_class(brightness: Column, under: float = 50.0, over: float = 210.0) -> Column:
    return F.when(brightness < under, "UNDEREXPOSED").when(brightness > over, "OVEREXPOSED").otherwise("NORMAL")


def is_blurred(score: Column, threshold: float = 100.0) -> Column:
    return score < threshold


def review_warnings(body_blur: Column, face: Column, score: Column) -> Column:
    """What a reviewer should look at, in the interface's fixed words."""
    percent = F.when(score <= 1.0, score * num(100)).otherwise(score)
    return compact(
        F.when(body_blur >= 0.45, F.lit("Body blur penalty tinggi")), F.when((face != 0) & (face < 0.35), F.lit("Face score rendah")),
        F.when(percent < 50, F.lit("Final score rendah")),
    )


def notes(blurry: Column, exposure: Column, has_face: Column, duplicate: Column, best: Column, error: Column | None = None) -> Column:
    words = F.concat_ws(
        "; ", F.when(blurry, F.lit("blur")).otherwise(F.lit("sharp")),
        F.when(exposure == "UNDEREXPOSED", F.lit("underexposed")).when(exposure == "OVEREXPOSED", F.lit("overexposed")).otherwise(F.lit("normal_exposure")),
        F.when(has_face, F.lit("has_face")).otherwise(F.lit("no_face")),
        F.when(duplicate, F.when(best, F.lit("best_duplicate")).otherwise(F.lit("duplicate_candidate"))),
    )
    return words if error is None else F.when(F.nullif(error, F.lit("")).isNotNull(), F.concat(F.lit("error: "), error)).otherwise(words)


def main_box(boxes: Column, width: Column, height: Column) -> Column:
    """The box of a struct array (x, y, w, h) that is large and central; of equals the first."""
    center = F.sqrt((width / 2.0) * (width / 2.0) + (height / 2.0) * (height / 2.0))

    def weight(b: Column) -> Column:
        dx, dy = b["x"] + b["w"] / 2.0 - width / 2.0, b["y"] + b["h"] / 2.0 - height / 2.0
        distance = F.least(F.sqrt(dx * dx + dy * dy) / center, num(1))
        return b["w"] * b["h"] / (width * height).cast("double") * num(0.75) + (num(1) - distance) * num(0.25)

    ranked = F.transform(boxes, lambda b, i: F.struct(weight(b).alias("s"), (-i).alias("i"), b.alias("box")))
    return F.array_max(ranked)["box"]


def crop_geometry(width: Column, height: Column, x_ratio: float, y_ratio: float, size: int) -> Column:
    """left, top and side of a square crop that stays inside the image."""
    side = F.greatest(F.lit(1), F.least(F.lit(size), width, height))
    share = lambda r: float(min(1.0, max(0.0, r)))
    place = lambda length, r: F.greatest(F.lit(0), F.least(F.floor(length * num(share(r))) - F.floor(side / 2), length - side))
    return F.struct(place(width, x_ratio).cast("int").alias("left"), place(height, y_ratio).cast("int").alias("top"), side.cast("int").alias("side"))


def person_blur(boxes: Column) -> Column:
    """count, main (of the largest box), mean and least sharpness over the positive ones of a struct array (w, h, sharpness), to two digits."""
    scores = F.filter(F.transform(boxes, lambda b: b["sharpness"]), lambda v: v > 0)
    largest = F.array_max(F.transform(boxes, lambda b, i: F.struct((b["w"] * b["h"]).alias("a"), (-i).alias("i"), b["sharpness"].alias("s"))))
    mean = F.aggregate(scores, num(0), lambda a, v: a + v) / F.size(scores)
    some = F.size(scores) > 0
    return F.struct(
        F.size(boxes).alias("count"), F.when(F.size(boxes) > 0, rounded(largest["s"], 2)).alias("main"), F.when(some, rounded(mean, 2)).alias("mean"), F.when(some, rounded(F.array_min(scores), 2)).alias("least")
    )
