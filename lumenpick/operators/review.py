"""Human review: decisions over automatic statuses, filters, progress, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.scalars import ai_status, decision, first_number, split_reasons


def latest_decisions(log: DataFrame, key: str = "photo_id", order: tuple[str, ...] = ("decision_updated_at",)) -> DataFrame:
    """Last write wins.  One struct maximum per key combines before the shuffle, so a busy key is no hot spot."""
    rest = [c for c in log.columns if c not in (key, *order)]
    newest = log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return newest.select(key, *[F.col(f"_last.{c}").alias(c) for c in (*order, *rest)])


def upserted(old: DataFrame, new: DataFrame, key: str = "photo_id") -> DataFrame:
    """new over old."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(decisions: DataFrame, ids: DataFrame, key: str = "photo_id") -> DataFrame:
    return decisions.join(ids.select(key).distinct(), key, "left_anti")


def review_items(rows: DataFrame) -> DataFrame:
    """Result rows of either naming as review items.

    Scores may be flat columns or a record `score` (or `scores`) with records face and body in it, whose numbers come first.
    Of several columns the first one that is not blank counts, row by row; missing columns
    count as blank.  A row is a winner if either flag says so.  Notes stand in for reasons where there
    are none, and a row without any name is "unknown".
    """
    have = dict(rows.dtypes)
    record = next((c for c in ("score", "scores") if isinstance(rows.schema[c].dataType if c in have else None, StructType)), None)

    def nested(*paths: str) -> list[Column]:
        """The fields of the score record that there are."""
        out = []
        for path in paths if record else ():
            kind, names = rows.schema[record].dataType, path.split(".")
            for name in names:
                kind = kind[name].dataType if isinstance(kind, StructType) and name in kind.names else None
            if kind is not None:
                out.append(F.col(f"{record}.{path}"))
        return out

    def text(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in have else F.lit(False)

    def numbers(*names: str, inside: tuple[str, ...] = ()) -> Column:
        return first_number(*[c.cast("string") for c in nested(*inside)], *[F.col(n).cast("string") for n in names if n in have])

    path = text("original_path", "path")
    name = F.coalesce(text("filename", "file_name"), F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("unknown"))
    listed = F.col("reasons") if have.get("reasons") == "array<string>" else split_reasons(text("reasons"))
    for own in nested("reasons"):
        listed = F.coalesce(own if isinstance(rows.select(own).schema[0].dataType, ArrayType) else split_reasons(F.nullif(own, F.lit(""))), listed)
    given = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda r: F.trim(r) != "")
    reasons = F.when(F.size(given) > 0, given).otherwise(split_reasons(text("final_reason", "notes")))
    return rows.select(
        F.coalesce(text("id", "photo_id"), path, name).alias("photo_id"), name.alias("filename"),
        path.alias("original_path"), ai_status(text("status", "output_status", "ai_status")).alias("ai_status"), decision(text("final_decision")).alias("final_decision"),
        text("cluster_id", "duplicate_group_id").alias("cluster_id"), (flag("is_cluster_winner") | flag("is_best_duplicate")).alias("is_cluster_winner"),
        numbers("score_percent", "final_score", inside=("final_score",)).alias("final_score"), numbers("face_score", inside=("face.face_score", "face_score")).alias("face_score"),
        numbers("body_sharpness", "body_sharpness_score", inside=("body.body_sharpness", "body_sharpness_score")).alias("body_sharpness"),
        numbers("body_blur_penalty", inside=("body.body_blur_penalty", "body_blur_penalty")).alias("body_blur_penalty"),
        text("thumbnail_path").alias("thumbnail_path"), reasons.alias("reasons"),
        F.lit(None).cast("string").alias("decision_updated_at"), F.lit("user").alias("decision_source"), F.coalesce(text("review_notes"), F.lit("")).alias("notes"),
    )


def with_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with their decision; undecided where there is none.  The optimiser broadcasts the decisions only while they are small."""
    d = decisions.select("photo_id", F.col("final_decision").alias("_d"), *[F.col(c).alias(f"_{c}") for c in ("decision_updated_at", "decision_source", "notes") if c in decisions.columns])
    out = items.join(d, "photo_id", "left").withColumn("final_decision", decision(F.col("_d")))
    for c in ("decision_updated_at", "decision_source", "notes"):
        if f"_{c}" in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)) if c in items.columns else F.col(f"_{c}"))
    return out.drop("_d", *[f"_{c}" for c in ("decision_updated_at", "decision_source", "notes")])


def progress(items: DataFrame) -> DataFrame:
    """One row: how many items have each decision and each automatic status."""
    d, a = decision(F.col("final_decision")), F.col("ai_status")
    return items.agg(
        F.count("*").alias("total"), *[F.count_if(d == x).alias(x) for x in ("post", "save", "delete", "undecided")],
        *[F.count_if(a == x).alias(f"ai_{x}") for x in ("selected", "review", "rejected")],
    )


def in_bucket(items: DataFrame, kind: str, value: str | None = None) -> DataFrame:
    """Items of one automatic status, decision or cluster, or all; unknown values are normalised first."""
    if kind == "ai_status":
        return items.filter(F.col("ai_status") == ai_status(F.lit(value)))
    if kind == "final_decision":
        return items.filter(F.col("final_decision") == decision(F.lit(value)))
    if kind == "cluster":
        return items.filter(F.col("cluster_id") == value)
    return items


def filtered(rows: DataFrame, statuses=(), exposures=(), blur: bool | None = None, face: bool | None = None, search: str = "", literal: bool = False) -> DataFrame:
    """The result table's filters; an empty choice filters nothing, the search is a case-insensitive pattern."""
    out = rows
    if statuses:
        out = out.filter(F.col("output_status").isin(*statuses))
    if exposures:
        out = out.filter(F.col("exposure_status").isin(*exposures))
    if blur is not None:
        out = out.filter(F.col("is_blur") == blur)
    if face is not None:
        out = out.filter(F.col("has_face") == face)
    if search:
        hit = F.contains(F.lower("filename"), F.lit(search.lower())) if literal else F.rlike("filename", F.lit(f"(?i){search}"))
        out = out.filter(F.coalesce(hit, F.lit(False)))
    return out


def item_by_id(items: DataFrame, photo_id: str) -> DataFrame:
    return items.filter(F.col("photo_id") == photo_id).limit(1)


def ring(items: DataFrame, within: list[str], order: list[str], key: str) -> DataFrame:
    """Adds next_id and previous_id, wrapping around at the ends; null keys have no place in a ring."""
    w = Window.partitionBy(*within).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return items.withColumn("next_id", F.coalesce(F.lead(key).over(w), F.first(key).over(whole))).withColumn("previous_id", F.coalesce(F.lag(key).over(w), F.last(key).over(whole)))


def neighbour(session: DataFrame, current_id: str, step: int = 1, visible: DataFrame | None = None, order: str = "seq", key: str = "photo_id") -> DataFrame:
    """The one item after (step 1) or before (step -1) an item among the visible ones, wrapping around; the first one for an unknown id.

    Without visible items those of the session count; no row only where these are none either.
    """
    shown = session if visible is None or visible.isEmpty() else visible
    here = shown.filter(F.col(key) == current_id).agg(F.min(order).alias("_here"))
    placed = shown.join(F.broadcast(here))  # one row
    beyond = (F.col(order) > F.col("_here")) if step > 0 else (F.col(order) < F.col("_here"))
    # the first beyond, else from the other end; an unknown id has nothing beyond and starts at the front
    side = F.when(F.col("_here").isNull(), 0).when(beyond, 0).otherwise(1)
    direction = F.col(order) if step > 0 else F.when(F.col("_here").isNull(), F.col(order)).otherwise(-F.col(order))
    return placed.orderBy(side, direction).limit(1).select(*shown.columns)


def displayed_path(original: Column, thumbnail: Column, original_exists: Column, thumbnail_exists: Column, prefer_thumbnail: bool) -> Column:
    """What a viewer shows: the preferred file if it exists, else the other, else null."""
    small, large = F.when(thumbnail_exists, thumbnail), F.when(original_exists, original)
    return F.coalesce(small, large) if prefer_thumbnail else F.coalesce(large, small)


def display_columns(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are, in that order, with the derived ones."""
    out = rows
    if "output_status" in out.columns:
        out = out.withColumn("status", F.col("output_status"))
    if "duplicate_group_id" in out.columns:
        out = out.withColumn("duplicate_group", F.col("duplicate_group_id"))
    if "is_blur" in out.columns:
        out = out.withColumn("blur_level", F.when(F.col("is_blur"), "Blur").otherwise("Sharp"))
    return out.select(*[c for c in wanted if c in out.columns])
