"""Copy plans: what goes where, under names that collide with nothing."""

from __future__ import annotations

import filecmp
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DECISION_FOLDERS, DECISION_ROOT, STATUS_FOLDERS
from ..functions.scalars import stem, suffix
from ..sources.files import files_below, place
from .numbering import LARGE_GROUP, large_groups, numbered_within


def status_folder(status: Column) -> Column:
    """The folder of a status; the one of errors for unknown and absent ones."""
    return F.coalesce(*[F.when(F.lower(status) == s, F.lit(f)) for s, f in STATUS_FOLDERS.items()], F.lit(STATUS_FOLDERS["error"]))


def numbered_name(name: Column, number: Column) -> Column:
    return F.when(number == 0, name).otherwise(F.concat(stem(name), F.lit("_"), number.cast("string"), suffix(name)))


def _numbered_parts(names: DataFrame, folder: str, name: str) -> DataFrame:
    """folder, name, number of names of the form stem_k: the name without the number, and k."""
    pattern = r"^(.*)_([1-9][0-9]{0,8})(\.[^.]*)?$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return names.select(folder, F.concat(part(1), part(3)).alias(name), part(2).try_cast("long").alias("_value")).filter("_value is not null")


def collision_free(rows: DataFrame, folder: str = "folder", name: str = "file_name", order: str = "seq", existing: DataFrame | None = None, large: int = LARGE_GROUP) -> DataFrame:
    """Adds destination_name: the name for its first row in a folder, then stem_1, stem_2 and so on.

    existing: columns folder and name of the files that are there already; none of them is overwritten.
    A numbered name may itself be a real name in the folder, here or there.  Numbers are
    therefore dealt among those that are free.  The j-th used number u leaves u - j
    free ones below it, so the n-th row steps over all used numbers with u - j <= n: how many, its place among
    both in one order tells.  A folder's name with more than `large` rows is numbered over several tasks.
    """
    key = [folder, name]
    used = _numbered_parts(rows.select(*key).distinct(), folder, name)
    if existing is not None:
        there = existing.select(*key).distinct()
        used = used.unionByName(_numbered_parts(there, folder, name)).unionByName(there.withColumn("_value", F.lit(0).cast("long")))
    used = used.distinct()
    huge = large_groups(rows.select(*key).unionByName(used.select(*key)), key, large)
    parts = numbered_within(rows, key, order, name="_nth", large=huge).withColumn("_nth", F.col("_nth") - 1)
    free = numbered_within(used, key, "_value", name="_rank", large=huge).select(*key, (F.col("_value") - F.col("_rank") + 1).alias("_value"), F.lit(None).cast("long").alias("_row"))
    asked = parts.select(*key, F.col("_nth").alias("_value"), F.col("_nth").alias("_row"))
    both = numbered_within(free.unionByName(asked), key, "_value", F.col("_row").isNotNull(), name="_place", large=huge).filter("_row is not null")
    # before a place stand the numbers asked and the used ones stepped over: together the number dealt
    dealt = both.select(*key, F.col("_row").alias("_nth"), (F.col("_place") - 1).alias("_number"))
    return parts.join(dealt, [*key, "_nth"]).withColumn("destination_name", numbered_name(F.col(name), F.col("_number"))).drop("_nth", "_number")


def should_export(decision: Column, include_undecided: bool = False) -> Column:
    wanted = ("post", "save", "delete", "undecided") if include_undecided else ("post", "save", "delete")
    return decision.isin(*wanted)


def export_counts(items: DataFrame, existing: DataFrame, include_undecided: bool = False) -> DataFrame:
    """One row: items per decision, all of them, and exported ones whose file (column original_path) does not exist."""
    there = existing.select("original_path").distinct().withColumn("_there", F.lit(True))
    joined = items.join(there, "original_path", "left")
    lost = should_export(F.col("final_decision"), include_undecided) & F.col("_there").isNull()
    return joined.agg(*[F.count_if(F.col("final_decision") == d).alias(d) for d in ("post", "save", "delete", "undecided")], F.count_if(lost).alias("missing"))


def missing_files(items: DataFrame, existing: DataFrame) -> DataFrame:
    return items.join(existing.select("original_path").distinct(), "original_path", "left_anti")


def existing_files(spark: SparkSession, root: str) -> DataFrame:
    """folder (below root) and file_name of all files below root, whatever their names; none where there is no such folder."""
    inner = F.substring("path", F.lit(len(place(root)[1].rstrip("/")) + 2), F.length("path"))
    return files_below(spark, root).select(F.regexp_extract(inner, r"^(.*)/[^/]*$", 1).alias("folder"), "file_name")


def _planned(placed: DataFrame, root: str, path: str, existing: DataFrame | None) -> DataFrame:
    named = collision_free(placed.filter("folder is not null"), existing=existing)
    return named.withColumns({"source": F.col(path), "destination": F.concat_ws("/", F.lit(root.rstrip("/")), "folder", "destination_name")})


def copy_plan(items: DataFrame, root: str, path: str = "path", status: str = "status", existing: DataFrame | None = None) -> DataFrame:
    """source, destination per item (failed and unknown statuses: the folder of errors); existing: what existing_files finds below root."""
    placed = items.withColumn("folder", status_folder(F.col(status)))
    return _planned(placed, root, path, existing).select("source", "destination")


def with_output_path(items: DataFrame, root: str, path: str = "path", status: str = "status", existing: DataFrame | None = None) -> DataFrame:
    """Items with output_path, where copy_plan puts them."""
    planned = _planned(items.withColumn("folder", status_folder(F.col(status))), root, path, existing)
    return planned.withColumn("output_path", F.col("destination")).select(*items.columns, "output_path")


def decision_plan(items: DataFrame, root: str, existing: DataFrame | None = None, include_undecided: bool = False) -> DataFrame:
    """source, destination of reviewed items whose decision is to be exported (columns original_path, filename, final_decision)."""
    decided = items.filter(should_export(F.col("final_decision"), include_undecided)).filter("original_path is not null")
    below = F.coalesce(*[F.when(F.col("final_decision") == d, F.lit(f"{DECISION_ROOT}/{f}")) for d, f in DECISION_FOLDERS.items()])
    placed = decided.select("original_path", F.element_at(F.split("original_path", "/"), -1).alias("file_name"), F.col("photo_id").alias("seq"), below.alias("folder"))
    return _planned(placed, root, "original_path", existing).select("source", "destination")


def run_copies(plan: DataFrame) -> DataFrame:
    """Copy where the data is: source, destination and an error per file; a lost file does not stop the others.

    A file appears under its final name only when it is complete, and no other file there is ever
    replaced: one with the same content counts as copied (a retried task), any other is an error.
    """

    def copy(a: str, b: str) -> str | None:
        part = Path(f"{b}.{uuid.uuid4().hex}.part")
        try:
            part.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(a, part)
            os.link(part, b)  # fails where b exists
        except FileExistsError:
            return None if filecmp.cmp(part, b, shallow=False) else f"the destination exists: {b}"
        except OSError as e:
            return str(e)
        finally:
            part.unlink(missing_ok=True)
        return None

    def run(batches):
        for pdf in batches:
            yield pdf.assign(error=[copy(a, b) for a, b in zip(pdf["source"], pdf["destination"], strict=True)])

    return plan.select("source", "destination").mapInPandas(run, "source string, destination string, error string")


def selected_only(items: DataFrame) -> DataFrame:
    return items.filter(F.lower("status") == "selected")
