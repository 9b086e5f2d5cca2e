"""Mixing sources to target weights by exact subset sums over document lengths.

Documents are counted by (source, length in words).  A source whose target
exceeds its size is taken once in full, and the rest of its target, or the
whole target otherwise, is a budget for choosing documents one (more) time:
every length first gives its proportional share of documents, then a bounded
knapsack over the lengths' remaining documents fills what is left of the budget
as closely as any selection can.  Which documents of a length are taken follows
a seeded hash, found per hash slice so that no length gathers in one task.

Defined results: null texts have size 0 and take nothing; null sources form
one source that sorts last; sources without words have target 0.  Repeated rows
are documents of their own.  Rows without a doc_id are mixed like any others, in an order of
their own.  Extra columns are ignored by mixture and pass through mixed_documents, whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (3, 1, 2)
#: All targets together, as a multiple of all sizes.
SHARE = 1.5
#: No document is taken more often than this.
REPEATS = 2
SEED = 20_240_613
#: Single documents are dealt until the budget left is at most this many words, or less than the longest document.
KNAPSACK_WORDS = 65_536
#: Hash slices of one source and length.
SLICES = 1024


def source_key(source: Column) -> Column:
    """Joins null sources with each other without clashing with any name."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Add `target` to one row per source (source, source_size).

    A target is weight * level, at most `repeats` times the size; the level is
    where the targets add up to the share of all sizes.  With the sources
    sorted by cap over weight, the first source that stays below its cap fixes
    the level; later ones would give a lower one.  The windows run over one row per source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sources.withColumn("_place", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size") * float(repeats))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("_full", F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0)))
        .withColumn("_rest", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(by_ratio), F.lit(0.0)))
        .withColumn("_level", (F.sum("source_size").over(whole) * share - F.col("_full")) / F.col("_rest"))
        .withColumn("_level", F.max(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))).over(whole))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap")))
    return ranked.withColumn("target", target).drop("_place", "_weight", "_cap", "_full", "_rest", "_level")


def best_subset(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length come closest to the budget from below.

    Reachable sums are the bits of an integer.  Counts are split into powers of
    two; each sum remembers the part that first reached it, and following those
    parts back never uses one twice.
    """
    parts: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        step = 1
        while length > 0 and count > 0 and length * step <= budget:
            use = min(step, count)
            if length * use <= budget:
                parts.append((i, use))
            count -= use
            step *= 2
    mask = (1 << (budget + 1)) - 1
    reached, first = 1, {}
    for k, (i, use) in enumerate(parts):
        fresh = (reached << (lengths[i] * use)) & mask & ~reached
        reached |= fresh
        while fresh:
            low = fresh & -fresh
            first[low.bit_length() - 1] = k
            fresh ^= low
        if reached >> budget:
            break
    left, taken = reached.bit_length() - 1, [0] * len(lengths)
    while left:
        i, use = parts[first[left]]
        taken[i] += use
        left -= lengths[i] * use
    return taken


def fit_budget(lengths: list[int], counts: list[int], budget: int, knapsack_words: int = KNAPSACK_WORDS) -> list[int]:
    """Documents per length: proportional shares, single ones by largest remainder, then the knapsack."""
    size = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if size == 0 or budget <= 0:
        return [0] * len(lengths)
    budget = min(budget, size)
    taken = [c * budget // size for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: (-(counts[i] * budget % size), lengths[i])):
        if left <= knapsack_words:
            break
        if 0 < lengths[i] <= left and taken[i] < counts[i]:
            taken[i] += 1
            left -= lengths[i]
    more = best_subset(lengths, [c - t for c, t in zip(counts, taken, strict=True)], left)
    return [t + m for t, m in zip(taken, more, strict=True)]


def _quotas(knapsack_words: int):
    def run(histogram: pd.DataFrame) -> pd.DataFrame:
        """Per length of one source: copies that all its documents get, and how many get one more."""
        histogram = histogram.sort_values("size")
        size, target = int(histogram["source_size"].iloc[0]), float(histogram["target"].iloc[0])
        every, budget = divmod(int(round(target)), size) if size else (0, 0)
        taken = fit_budget(histogram["size"].tolist(), histogram["docs"].tolist(), budget, knapsack_words)
        return histogram.assign(every=every, quota=taken)[["_source", "size", "source_size", "target", "every", "quota"]]

    return run


def plan_mixture(docs: DataFrame, size: Column, seed: int = SEED, knapsack_words: int = KNAPSACK_WORDS) -> DataFrame:
    """Per row of docs: row (the whole row as a struct), mix_size, mix_source_size, mix_target and mix_copies (times that the mix takes the row).

    size: the words of a row, an expression over docs.  knapsack_words: how much of a budget at most is left to the exact subset sum.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), source_key(F.col("source")).alias("_source"), size.alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("_order"), "doc_id", "source",
    ).withColumn("_slice", F.shiftright("_order", 54))
    sliced = packed.groupBy("_source", "size", "_slice").agg(F.count("*").alias("in_slice"), F.max("source").alias("source"))
    histogram = sliced.groupBy("_source", "size").agg(F.sum("in_slice").alias("docs"), F.max("source").alias("source"))
    sources = histogram.groupBy("_source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.max("source").alias("source"))
    targets = with_targets(sources).drop("source")
    quotas = histogram.join(targets, "_source").groupBy("_source").applyInPandas(
        _quotas(knapsack_words), "_source string, size long, source_size long, target double, every long, quota long"
    )
    earlier = Window.partitionBy("_source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.drop("source").withColumn("_before", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)))
    slices = slices.join(quotas, ["_source", "size"])
    in_slice = Window.partitionBy("_source", "size", "_slice").orderBy("_order", "doc_id")
    return (
        packed.drop("source").join(slices, ["_source", "size", "_slice"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(in_slice))
        .withColumn("copies", F.col("every") + (F.col("_rank") <= F.col("quota")).cast("long"))
        .select(F.col("_row").alias("row"), *[F.col(c).alias(f"mix_{c}") for c in ("size", "source_size", "target", "copies")])
    )


def mixture(docs: DataFrame, seed: int = SEED, knapsack_words: int = KNAPSACK_WORDS) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken."""
    sized = Scratch(docs.sparkSession).keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    plan = plan_mixture(sized, F.col("words"), seed, knapsack_words)
    return plan.select(
        "row.doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = SEED, knapsack_words: int = KNAPSACK_WORDS) -> DataFrame:
    """The mix itself: each document row as often as it is taken."""
    plan = plan_mixture(docs, word_count(F.col("text")), seed, knapsack_words).filter((F.col("mix_copies") > 0) & (F.col("mix_size") > 0))
    copies = plan.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return copies.select(*[F.col(f"row.`{c}`") for c in docs.columns])
