"""Numbers in a global order without a task that sees all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written

#: monotonically_increasing_id holds the partition above this many bits and the place in it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """Adds 1, 2, ... in the given order.

    Range partitions are sorted on their own, each numbered after the rows of those
    before it; only the row counts of the partitions are summed up in one task.
    """
    # the bounds come from a sample, so the rows are read twice: written once, they are computed once
    placed = written(written(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    # one row per partition, so small enough to broadcast at any size of the input
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_at", "_before")


#: Rows of a group that one task may sort.
LARGE_GROUP = 1 << 20


def large_groups(rows: DataFrame, by: list[str], large: int = LARGE_GROUP) -> DataFrame | None:
    """The keys of groups of more than `large` rows, at most rows / large of them; None where there are none."""
    found = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > large).select(*by)
    kept = found.collect()
    return rows.sparkSession.createDataFrame(kept, found.schema) if kept else None


def numbered_within(rows: DataFrame, by: list[str], *order: Column | str, name: str = "number", large: DataFrame | None = None) -> DataFrame:
    """Adds 1, 2, ... within groups of equal keys.

    A group is one task's work, but for those of `large` (as `large_groups` gives them), which are numbered over range partitions.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    if large is None:
        return rows.withColumn(name, F.row_number().over(window).cast("long"))
    keys = large.select(*[F.col(c).alias(f"_key_{c}") for c in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by])
    small = rows.join(F.broadcast(keys), same, "left_anti").withColumn(name, F.row_number().over(window).cast("long"))
    placed = numbered(rows.join(F.broadcast(keys), same, "left_semi"), *by, *order, name="_place")
    first = placed.groupBy(*[F.col(c).alias(f"_key_{c}") for c in by]).agg(F.min("_place").alias("_first"))
    split = placed.join(F.broadcast(first), same).withColumn(name, F.col("_place") - F.col("_first") + 1)  # a row per large group
    return small.unionByName(split.select(*rows.columns, name))
