"""MinHash near-deduplication with circulant signatures, banding and exact verification.

Texts are sets of distinct word shingles (A-Z lower-cased).  Two permutations of
the 32-bit ring make every signature coordinate: the first shuffles the
shingle hashes once, the second is read circularly shifted by k for coordinate
k.  Documents with the same set form a class, represented by its smallest
doc_id; only representatives go on.

Representatives that agree on a band meet in a bucket.  A bucket never lists all
its pairs: its smallest member (the leader) is compared exactly with every
other one, and components are formed.  Buckets that then still hold several
components compare the members outside the largest component with a few of its members
(pivots, one per hash slot), in rounds with other slots for as long as that
joins many of them.  What remains, pairs of different components, goes through
an exact prefix join over the shingles in order of rising frequency, so
far variants of a family need not be compared with all of it; every pair it yields is
verified on the full sets of both texts.  There is no cap.

A pair at exactly the bound of 0.8 misses all bands with probability
(1 - 0.8^5)^32 = 3e-6, more similar ones more rarely.

Defined results: null and blank texts have an empty set, link with nothing and
are their own component.  Rows that repeat a doc_id belong to one document whose
rows link as any of them does.  Rows without a doc_id link with nothing: their component_id is
null, and they are kept.  Extra columns are ignored, or kept
where document rows are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import Scratch, arrow_map
from .wordhash import column_words, mix, offsets_array, prefix_sums, ranges, run_hashes, window_hashes, word_hashes

SHINGLE_WORDS = 5
BANDS = 32
ROWS = 5
#: Linked if at least this share of the union is common.
PERCENT = 80
PIVOTS = 8
#: Another round of pivots follows while this share of the members outside has joined, and at most so many.
WORTHWHILE = 0.3
PIVOT_ROUNDS = 6

_BLOCK = 1024


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter text is one shingle of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    used = min(width, len(words))
    return np.unique(mix(window_hashes(prefix_sums(word_hashes(words)), used) + np.uint64(used)) if len(words) > used else
                     mix(prefix_sums(word_hashes(words))[-1:] + np.uint64(used)))


def _ring(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit ring."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(a)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(b)
    return x ^ (x >> np.uint32(16))


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k: the least of second(first(x) + k), sums taken around the ring."""
    first = _ring(shingles.astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(first), _BLOCK):
        np.minimum(out, _ring(first[None, i : i + _BLOCK] + shifts, 0x7FEB352D, 0x846CA68B).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return keys


def shingle_sets(column: pa.Array, width: int):
    """shingle_set of every row, with all words hashed at once."""
    for words in column_words(column, lower=True):
        sums = prefix_sums(words.hashes)
        n = np.diff(words.bounds)
        used = np.minimum(n, width)
        counts = np.where(n > 0, n - used + 1, 0)
        at, size = ranges(words.bounds[:-1], counts), np.repeat(used, counts)
        hashes = mix(run_hashes(sums, at, at + size) + size.astype(np.uint64))
        for own in np.split(hashes, np.cumsum(counts)[:-1]):
            yield np.unique(own)


def _signature_rows(width: int):
    def run(batch: pa.RecordBatch) -> dict:
        ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
        out, keys = {k: [] for k in ("n", "f1", "f2")}, []
        for shingles in shingle_sets(texts, width):
            out["n"].append(len(shingles))
            out["f1"].append(int(shingles.sum(dtype=np.uint64).view(np.int64)))
            out["f2"].append(int(mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64)))
            keys.append(band_keys(signature(shingles)).view(np.int64) if len(shingles) else np.zeros(0, np.int64))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return out | {"doc_id": ids, "bands": offsets_array(flat, np.array(list(map(len, keys)), np.int64))}

    return run


def _verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """pairs (u, v) with `common` and `joint`, the sizes of intersection and union of the full sets."""
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text"))

    def run(batch: pa.RecordBatch) -> dict:
        u, v, u_text, v_text = (batch.column(batch.schema.get_field_index(c)) for c in ("u", "v", "u_text", "v_text"))
        last, last_set, common, joint = None, None, [], []
        for i, t in enumerate(u.to_pylist()):
            text = u_text[i].as_py()
            if last_set is None or (t, text) != last:  # rows arrive sorted by u
                last, last_set = (t, text), shingle_set(text, width)
            other = shingle_set(v_text[i].as_py(), width)
            same = len(np.intersect1d(last_set, other, assume_unique=True))
            common.append(same)
            joint.append(len(last_set) + len(other) - same)
        return {"u": u, "v": v, "common": common, "joint": joint}

    return arrow_map(pairs.select("u", "v").join(right.hint("merge"), "v").join(left.hint("merge"), "u"), run, "u long, v long, common int, joint int")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    no_id = F.col("doc_id").isNull()
    sigs = scratch.keep(arrow_map(texts, _signature_rows(shingle_words), "doc_id long, n int, f1 long, f2 long, bands array<long>"))
    same_set = ["n", "f1", "f2"]
    classes = scratch.keep(
        sigs.filter("n > 0 and doc_id is not null").groupBy(*same_set).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    )

    keyed = classes.select("rep", F.explode("bands").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).filter("members > 1").drop("members")
    buckets = scratch.keep(keyed.join(leaders, "key"))
    pairs = scratch.keep(buckets.filter("rep > leader").select(F.col("leader").alias("u"), F.col("rep").alias("v")).distinct())
    met = pairs.select("v").union(pairs.select("u")).distinct().select(F.col("v").alias("doc_id"))
    texts = scratch.keep(texts.join(met.hint("merge"), "doc_id"))

    linked = F.col("common") * 100 >= F.col("joint") * PERCENT
    known = scratch.keep(_verify(pairs, texts, shingle_words))
    edges = scratch.keep(known.filter(linked).select("u", "v"))
    labels = scratch.keep(components(edges, scratch))
    members = buckets.select("key", "rep")
    open_buckets = _open_buckets(scratch, members, labels)
    outside, before = _members_outside(open_buckets), None
    for turn in range(PIVOT_ROUNDS):
        if not outside or (before and outside > before * (1 - WORTHWHILE)):
            break
        slot = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(PIVOTS))
        pivots = scratch.keep(open_buckets.filter("in_first").groupBy("key", slot.alias("slot")).agg(F.min("rep").alias("pivot")))
        more = open_buckets.filter("not in_first").select("key", "rep").join(pivots, "key")
        more = more.select(F.least("pivot", "rep").alias("u"), F.greatest("pivot", "rep").alias("v")).distinct()
        fresh = scratch.keep(_verify(more.join(known, ["u", "v"], "left_anti"), texts, shingle_words))
        known = scratch.keep(known.unionByName(fresh))
        edges = scratch.keep(edges.unionByName(fresh.filter(linked).select("u", "v")))
        labels = scratch.keep(components(edges, scratch))
        open_buckets = _open_buckets(scratch, open_buckets.select(*members.columns), labels)
        outside, before = _members_outside(open_buckets), outside

    if outside:
        rest = _possible_links(scratch, open_buckets, texts, shingle_words).join(known, ["u", "v"], "left_anti")
        last = _verify(rest, texts, shingle_words).filter(linked).select("u", "v")
        labels = components(edges.unionByName(last), scratch)

    of_class = classes.select(*same_set, "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = of_class.select(*same_set, F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", *same_set).join(of_class, same_set, "left")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(~no_id, F.coalesce("component", "doc_id")).alias("component_id"),
        (no_id | (F.coalesce("component", "doc_id") == F.col("doc_id"))).alias("kept"),
    )


def _possible_links(scratch: Scratch, members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (u, v) of different components, one outside, that could be linked: an exact prefix join.

    Sets of sizes n and m at share p have p / (1 + p) * (n + m) shingles in common, so
    in any fixed order the first common one is near the front of both.  In order of
    rising frequency the fronts hold rare shingles, and what counts as the front depends on both
    sizes, hence the size classes.
    """
    log_step = float(np.log(1.05))

    def shingled(batch: pa.RecordBatch) -> dict:
        ids, rows = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
        sets = [shingle_set(t.as_py(), width) for t in rows]
        return {"rep": np.repeat(ids.to_numpy(), [len(x) for x in sets]), "shingle": np.concatenate(sets).view(np.int64) if sets else []}

    reps = scratch.keep(members.groupBy("rep").agg(F.min("component").alias("component"), F.bool_or(~F.col("in_first")).alias("outside")))
    held = scratch.keep(arrow_map(texts.join(reps.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id"), shingled, "rep long, shingle long").distinct())
    frequency = scratch.keep(held.groupBy("shingle").agg(F.count("*").alias("docs")))
    ordered = held.join(frequency.hint("merge"), "shingle").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("docs", "shingle"))).alias("shingles"))
    ordered = ordered.join(reps, "rep").withColumn("n", F.size("shingles")).withColumn("class", F.floor(F.log("n") / log_step).cast("int"))
    ordered = scratch.keep(ordered)
    bounds: dict[bool, dict[int, tuple[int, int]]] = {True: {}, False: {}}
    for r in ordered.groupBy("outside", "class").agg(F.min("n").alias("low"), F.max("n").alias("high")).collect():  # a row per size class
        for side in {False, r["outside"]}:  # all, and those outside
            low, high = bounds[side].get(r["class"], (r["low"], r["high"]))
            bounds[side][r["class"]] = (min(low, r["low"]), max(high, r["high"]))

    def fronts(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("shingle", "out_class", "any_class", "rep", "component", "place", "n", "asks")}
        columns = (batch.column(batch.schema.get_field_index(c)) for c in ("rep", "component", "outside", "n", "class", "shingles"))
        for rep, component, outside, n, own, shingles in zip(*columns, strict=True):
            n, own = n.as_py(), own.as_py()
            docs, ids = (shingles.values.field(f).to_numpy() for f in ("docs", "shingle"))
            for asks in ((True, False) if outside.as_py() else (False,)):
                for other, (low, high) in bounds[not asks].items():
                    if high * 100 < n * PERCENT or n * 100 < low * PERCENT:
                        continue
                    least = max(low, -(-n * PERCENT // 100))
                    front = n - -(-PERCENT * (n + least) // (100 + PERCENT)) + 1
                    at = np.flatnonzero(docs[:front] > 1)
                    out["shingle"] += ids[at].tolist()
                    out["place"] += at.tolist()
                    for key, value in (("out_class", own if asks else other), ("any_class", other if asks else own), ("rep", rep.as_py()), ("component", component.as_py()), ("n", n), ("asks", asks)):
                        out[key] += [value] * len(at)
        return out

    keys = scratch.keep(arrow_map(ordered.select("rep", "component", "outside", "n", "class", "shingles"), fronts, "shingle long, out_class int, any_class int, rep long, component long, place int, n int, asks boolean"))
    on = ["shingle", "out_class", "any_class"]
    one = keys.filter("asks").select(*on, *[F.col(c).alias(f"u_{c}") for c in ("rep", "component", "place", "n")])
    two = keys.filter("not asks").select(*on, *[F.col(c).alias(f"v_{c}") for c in ("rep", "component", "place", "n")])
    needed = (F.col("u_n") + F.col("v_n")) * PERCENT
    met = one.join(two, on).filter(
        (F.col("u_component") != F.col("v_component")) & (F.least("u_n", "v_n") * 100 >= F.greatest("u_n", "v_n") * PERCENT)
        & (F.least(F.col("u_n") - F.col("u_place"), F.col("v_n") - F.col("v_place")) * (100 + PERCENT) >= needed)
    )
    return met.select(F.least("u_rep", "v_rep").alias("u"), F.greatest("u_rep", "v_rep").alias("v")).distinct()


def _members_outside(open_buckets: DataFrame) -> int:
    return open_buckets.filter("not in_first").select("rep").distinct().count()


def _open_buckets(scratch: Scratch, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with `component` and whether that is the bucket's largest (in_first)."""
    own = labels.select(F.col("node").alias("rep"), "component")
    marked = scratch.keep(members.join(own, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    sizes = marked.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
    largest = sizes.agg(F.max_by("component", "n").alias("first"), F.count("*").alias("found")).filter("found > 1").drop("found")
    return scratch.keep(marked.join(scratch.keep(largest), "key").withColumn("in_first", F.col("component") == F.col("first")).drop("first"))


def one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The document rows that are their group's smallest doc_id, with all their columns."""
    gone = near_duplicates(docs, shingle_words).filter("not kept").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)
