"""Ranking within clusters, statuses and their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import kept_per_cluster, pick_limits
from ..functions.scalars import clamp01, compact, num, two_decimals
from .numbering import numbered

RANK_KEYS = ("final_score", "subject_score", "body_clarity", "face_score", "sharpness")
#: Columns of the winner that reasons refer to.
_WINNER = ("photo_id", "file_name", "final_score", "body_blur_penalty", "face_score")


#: Rows of a cluster that one task may sort; larger clusters are ranked over range partitions.
LARGE_CLUSTER = 1 << 20


def _rank_order() -> list[Column]:
    return [F.col("final_score").desc(), F.col("subject_score").desc(), (num(1) - F.col("body_blur_penalty")).desc(), F.col("face_score").desc(), F.col("sharpness").desc(), F.lower("file_name"), F.col("seq")]


def ranked(items: DataFrame, large: int = LARGE_CLUSTER, dealt: DataFrame | None = None) -> DataFrame:
    """Adds rank, cluster_size and `winner` (a struct) per cluster_id; ties go by lower-cased name, then seq.

    One sort per cluster gives all three.  Clusters of more than `large` rows, of which there are at most
    rows / large, are counted first and ranked over range partitions instead, so none is one task's work.
    dealt: the same items, worked out from rows that were repartitioned by the very expression of cluster_id,
    so that these narrower rows are shuffled and not the items.
    """
    dealt = items if dealt is None else dealt
    sizes = items.groupBy(F.col("cluster_id").alias("_cluster")).agg(F.count("*").alias("_n"))
    huge = [r["_cluster"] for r in sizes.filter(F.col("_n") > large).select("_cluster").collect()]
    if not huge:
        return _ranked_by_window(dealt)
    is_huge = F.col("cluster_id").isin([c for c in huge if c is not None])
    is_huge = F.coalesce(is_huge, F.lit(None in huge))
    names = [*items.columns, "rank", "cluster_size", "winner"]
    return _ranked_by_window(dealt.filter(~is_huge)).select(names).unionByName(_ranked_by_range(items.filter(is_huge)).select(names))


def _ranked_by_window(items: DataFrame) -> DataFrame:
    cluster = Window.partitionBy("cluster_id").orderBy(*_rank_order())
    whole = cluster.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct(*_WINNER)).over(cluster.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return items.withColumns({"rank": F.row_number().over(cluster), "cluster_size": F.count(F.lit(1)).over(whole), "winner": first})


def _ranked_by_range(items: DataFrame) -> DataFrame:
    """Numbers in the order of clusters and ranks; a cluster's first number, size and winner come from an aggregate."""
    rows = numbered(items, F.col("cluster_id"), *_rank_order(), name="_number")
    clusters = rows.groupBy(F.col("cluster_id").alias("_cluster")).agg(F.min(F.struct("_number", *_WINNER)).alias("_first"), F.count("*").alias("cluster_size"))
    joined = rows.join(F.broadcast(clusters), F.col("cluster_id").eqNullSafe(F.col("_cluster")))  # as few as there are large clusters
    return joined.withColumns({
        "rank": (F.col("_number") - F.col("_first._number") + 1).cast("int"), "winner": F.struct(*[F.col(f"_first.{c}").alias(c) for c in _WINNER]),
    }).drop("_cluster", "_number", "_first")


def picked(items: DataFrame, mode: str = "balanced", keep: int | None = None, dealt: DataFrame | None = None) -> DataFrame:
    """Adds is_cluster_winner, score_gap, duplicate_penalty and status to ranked items; dealt: as in `ranked`."""
    select_from, review_from, close = pick_limits(mode)
    keep = kept_per_cluster(mode) if keep is None else keep
    r = ranked(items, dealt=dealt)
    gap = F.col("winner.final_score") - F.col("final_score")
    score, first = F.col("final_score"), F.col("rank") == 1
    by_score = F.when(score >= review_from, "review").otherwise("rejected")
    if mode == "aggressive":
        loser: Column = F.lit("rejected")
    elif mode == "conservative":
        loser = F.when((F.col("rank") <= keep) & (gap <= close), "review").otherwise(by_score)
    elif mode == "balanced":
        loser = F.when(gap <= close, "review").otherwise(by_score)
    else:
        loser = by_score
    return (
        r.withColumn("is_cluster_winner", first)
        .withColumn("score_gap", gap)
        .withColumn("duplicate_penalty", F.when(first, num(0)).otherwise(clamp01(gap)))
        .withColumn("status", F.when(first, F.when(score >= select_from, "selected").otherwise(by_score)).otherwise(loser))
    )


def simply_picked(items: DataFrame, mode: str = "conservative", close: float = 0.08) -> DataFrame:
    """The earlier picker: the best, and close followers where the mode allows; the others are rejected."""
    r = ranked(items)
    near = F.col("winner.final_score") - F.col("final_score") <= close
    follows = F.lit(False)
    if mode == "conservative":
        follows = F.col("rank").between(2, 3) & near
    elif mode == "balanced":
        follows = (F.col("cluster_size") >= 4) & (F.col("rank") == 2) & near
    return r.withColumn("status", F.when((F.col("rank") == 1) | follows, "selected").otherwise("rejected"))


def reasons(mode: str) -> Column:
    """Why a picked item has its status: the fixed texts in their fixed order."""
    winner, single = F.col("is_cluster_winner"), F.col("cluster_size") <= 1
    follower = ~single & ~winner & F.col("winner").isNotNull()
    gap = F.greatest(num(0), F.col("winner.final_score") - F.col("final_score"))
    body_gap = F.col("body_blur_penalty") - F.col("winner.body_blur_penalty")
    face_gap = F.col("winner.face_score") - F.col("face_score")
    close_review = (gap <= 0.08) & (F.col("status") == "review")
    text = F.lit
    # The texts of the reasons and the limits at which they apply.
    return compact(
        F.when(single, text("Unique image; decision is based on its own technical, face, and body scores."))
        .when(winner, text("Selected as best image in similar cluster."))
        .when(F.col("winner").isNotNull(), F.concat(text("Similar to "), F.col("winner.file_name"), text("; final score lower by "), two_decimals(gap), text(".")))
        .otherwise(text("Similar cluster candidate; selected winner could not be resolved.")),
        F.when(follower & (body_gap >= 0.08), F.concat(text("Body blur penalty higher than winner by "), two_decimals(body_gap), text("."))),
        F.when(follower & (face_gap >= 0.08), F.concat(text("Face score lower than winner by "), two_decimals(face_gap), text("."))),
        F.when(follower & close_review, text("Close candidate kept for manual review.")).when(follower & (gap > 0.15), text("Large score gap from selected winner.")),
        F.when((F.lit(mode) == "aggressive") & (F.col("status") == "rejected") & ~winner, text("Aggressive mode rejects duplicate alternatives unless they clearly win.")),
        F.when((F.lit(mode) == "conservative") & (F.col("status") == "review") & ~winner, text("Conservative mode keeps close duplicate candidates for review.")),
        F.when(~F.col("face_detected"), text("No face detected.")).when(F.col("face_sharpness") >= 0.55, text("Good face sharpness."))
        .when(F.col("face_sharpness") > 0, text("Face detected but face sharpness is weak.")).otherwise(text("Face detected.")),
        F.when(F.col("body_blur_penalty") >= 0.45, text("Body/subject blur detected.")).when(F.col("subject_score") >= 0.65, text("Body/subject region is sharp.")),
        F.when(F.col("global_blur_penalty") >= 0.55, text("Low global sharpness.")).when(F.col("sharpness") >= 0.65, text("Good global sharpness.")),
        F.when(F.col("exposure") >= 0.65, text("Good exposure.")).when(F.col("exposure") < 0.30, text("Poor exposure.")),
    )


def typed_reasons(status: Column, texts: Column) -> Column:
    """Reasons as structs; items in review get none."""
    def kind(name: str, code: str) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(name).alias("type"), F.lit(code).alias("code"), t.alias("message")))

    empty = F.filter(kind("neutral", ""), lambda _: F.lit(False))
    return F.when(status == "selected", kind("positive", "SELECTED_REASON")).when(status == "rejected", kind("negative", "REJECTED_REASON")).otherwise(empty)
