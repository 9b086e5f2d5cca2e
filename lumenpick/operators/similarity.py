"""Near-duplicate clustering of 64-bit hashes."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..config import HASH_THRESHOLD
from ..functions.scalars import hamming
from ..plans.storage import written
from .components import components
from .numbering import numbered

_BLANKS = re.compile("[ \\n\\t\\r]+")


#: Bits that a key of the pair join should have at least, hashes of one block, and pairs compared at a time.
_KEY_BITS = 10
BLOCK = 4096
_TILE = 1 << 20
_MOST_KEYS = 500


def _banding(threshold: int, width: int, n: int) -> tuple[int, list[tuple[int, int]]] | None:
    """How many bands must agree at once, and the bands as bit ranges; None where comparing all hashes costs less.

    Weighs the keys that n hashes send against the pairs left to compare, some 200 to one.
    """
    costs = {0: n / 2 + 200 * -(-n // BLOCK)}
    for m in range(1, 5):
        bands = threshold + m
        if bands <= width and comb(bands, m) <= _MOST_KEYS and width * m / bands >= _KEY_BITS / 2:
            costs[m] = comb(bands, m) * (n / 2 ** (width * m / bands) / 2 + 200)
    m = min(costs, key=costs.get)
    return (m, _cuts(m, threshold, width)) if m else None


def close_pairs(hashes: DataFrame, threshold: int = HASH_THRESHOLD, width: int = 64, block: int = BLOCK) -> DataFrame:
    """a, b, distance for all pairs of one row per hash (columns id, hash) with a < b that differ in at most `threshold` bits.

    `width`: bits that hashes use, the higher ones being equal.  Hashes are cut into
    threshold + m bands; differing bits spoil at most `threshold` of them, so two hashes within it agree
    in m bands at least and meet under a key of m bands.  Where no choice of bands is selective, as beyond some
    twelve bits, all hashes have one key and n hashes cost n * n / 2 comparisons.

    The hashes of a key are dealt into blocks of about `block`, and every pair of blocks is compared in one task by
    counting the bits of whole arrays, so a crowded key is many tasks' work.  A pair that shares
    several keys is given under the first only.
    """
    keyed, first = _keyed(hashes.select("id", "hash"), threshold, _banding(threshold, width, hashes.count()))
    # keys of more than a block, of which there are at most as many as blocks of keyed hashes
    sizes = keyed.groupBy("no", "value").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    placed = keyed.join(sizes, ["no", "value"], "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "own": F.pmod(F.xxhash64("hash"), F.coalesce("blocks", F.lit(1))).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.select("id", "hash", "no", "value", "own", other.alias("other")).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    met = dealt.select("no", "value", "low", "high", "own", "id", "hash")
    key = ["no", "value", "low", "high"]
    kind = hashes.schema["id"].dataType.simpleString()
    found = met.repartition(*key).sortWithinPartitions(*key, "own").mapInArrow(_comparer(threshold, first), f"a {kind}, b {kind}, distance int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def _cuts(together: int, threshold: int, width: int) -> list[tuple[int, int]]:
    bands = threshold + together
    return [(width * i // bands, width * (i + 1) // bands) for i in range(bands)]


def _keyed(hashes: DataFrame, threshold: int, banding: tuple[int, list[tuple[int, int]]] | None) -> tuple[DataFrame, tuple | None]:
    """hashes with no, value: a row per key; and what tells a pair's first key (None where all hashes have one key)."""
    if banding is None:
        return hashes.withColumns({"no": F.lit(0), "value": F.lit(0).cast("long")}), None
    together, cuts = banding
    masks = [(1 << high) - (1 << low) for low, high in cuts]
    chosen = list(combinations(range(len(cuts)), together))
    keys = [F.struct(F.lit(i).alias("no"), F.col("hash").bitwiseAND(F.lit(_signed(sum(masks[j] for j in c)))).alias("value")) for i, c in enumerate(chosen)]
    first = np.array([_signed(m) for m in masks], np.int64), {c: i for i, c in enumerate(chosen)}, together
    return hashes.select("*", F.inline(F.array(*keys))), first


#: Bands of an index that must agree at once.
INDEX_BANDS = 2


def band_index(hashes: DataFrame, threshold: int = HASH_THRESHOLD, width: int = 64, together: int = INDEX_BANDS) -> DataFrame:
    """no, value, id, hash: the keys of hashes (id, hash) as a table that is kept and grows with them."""
    return _keyed(hashes.select("id", "hash"), threshold, (together, _cuts(together, threshold, width)))[0].select("no", "value", "id", "hash")


def pairs_with(fresh: DataFrame, index: DataFrame, threshold: int = HASH_THRESHOLD, width: int = 64, together: int = INDEX_BANDS, block: int = BLOCK) -> DataFrame:
    """a (of the index), b (fresh), distance of all close pairs between fresh hashes (id, hash) and those of a band index.

    Of the index only keys that fresh hashes have are taken up.  Either side of a crowded key is dealt into blocks.
    """
    keyed, first = _keyed(fresh.select("id", "hash"), threshold, (together, _cuts(together, threshold, width)))
    key = ["no", "value"]
    asked = keyed.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("new_blocks"))
    known = index.join(asked, key)
    held = known.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("old_blocks"), F.first("new_blocks").alias("new_blocks"))
    turn = lambda n: F.pmod(F.xxhash64("hash"), n).cast("int")
    new = keyed.join(held, key).withColumn("low", -1 - turn(F.col("new_blocks"))).withColumn("high", F.explode(F.sequence(F.lit(1), F.col("old_blocks"))))
    old = known.join(held.select(*key, "old_blocks"), key).withColumn("high", 1 + turn(F.col("old_blocks"))).withColumn("low", F.explode(F.sequence(-F.col("new_blocks"), F.lit(-1))))
    rows = new.select(*key, "low", "high", F.col("low").alias("own"), "id", "hash").unionByName(old.select(*key, "low", "high", F.col("high").alias("own"), "id", "hash"))
    kind = fresh.schema["id"].dataType.simpleString()
    run = [*key, "low", "high"]
    found = rows.repartition(*run).sortWithinPartitions(*run, "own").mapInArrow(_comparer(threshold, first, ("b", "a", "distance")), f"b {kind}, a {kind}, distance int")
    return found.select("a", "b", "distance")


def _comparer(threshold: int, first: tuple | None, names: tuple = ("a", "b", "distance")):
    """Compares the hashes of every run of rows with one key and pair of blocks; the first of a pair is of the lower block."""

    def pairs(key: tuple, held: list[tuple[np.ndarray, pa.Array, np.ndarray]]):
        own, ids, hashes = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
        no, _, low, high = key
        cut = int(np.searchsorted(own, low, "right")) if low != high else 0
        rows = len(hashes) if low == high else cut
        step = max(1, _TILE // max(1, len(hashes)))
        for at in range(0, rows, step):
            begin = at + 1 if low == high else cut
            mine, others = hashes[at : min(at + step, rows)], hashes[begin:]
            apart = np.bitwise_count((mine[:, None] ^ others[None, :]).view(np.uint64))
            x, y = np.nonzero(apart <= threshold)
            x, y, distance = x + at, y + begin, apart[x, y]
            if low == high:
                keep = y > x
                x, y, distance = x[keep], y[keep], distance[keep]
            if first is not None and len(x):
                masks, numbers, together = first
                agree = ((hashes[x] ^ hashes[y])[:, None] & masks[None, :]) == 0
                own_key = np.array([numbers[tuple(np.flatnonzero(row)[:together].tolist())] == no for row in agree])
                x, y, distance = x[own_key], y[own_key], distance[own_key]
            if len(x):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(distance.astype(np.int32))], names)

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], axis=1)
            own, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 6))
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, stop in pairwise(edges):
                mine = tuple(keys[start].tolist())
                if mine != key and held:
                    yield from pairs(key, held)
                    held = []
                key = mine
                held.append((own[start:stop], batch.column(5).slice(start, stop - start), hashes[start:stop]))
        if held:
            yield from pairs(key, held)

    return run


def _signed(x: int) -> int:
    """The 64-bit pattern as a signed number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def compared_pairs(hashes: DataFrame, threshold: int = HASH_THRESHOLD) -> DataFrame:
    """The same by comparing every pair; for small inputs and for checking the banded join."""
    left, right = hashes.select(F.col("id").alias("a"), F.col("hash").alias("a_hash")), hashes.select(F.col("id").alias("b"), F.col("hash").alias("b_hash"))
    distance = hamming(F.col("a_hash"), F.col("b_hash"))
    return left.join(right, (F.col("a") < F.col("b")) & (distance <= threshold)).select("a", "b", distance.cast("int").alias("distance"))


def grouped(items: DataFrame, threshold: int = HASH_THRESHOLD, width: int = 64) -> DataFrame:
    """Adds `component` to items (id, hash): the smallest id joined by a chain of close pairs.

    Items with equal hashes collapse to one before pairs are formed; items
    without a hash stay alone.
    """
    items = written(items)  # hashes are worked out once
    unique = written(items.filter("hash is not null").groupBy("hash").agg(F.min("id").alias("id")))
    pairs = close_pairs(unique, threshold, width)
    labels = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of_hash = unique.join(labels.withColumnRenamed("node", "id"), "id", "left").select("hash", F.coalesce("component", "id").alias("_component"))
    return items.join(of_hash, "hash", "left").withColumn("component", F.coalesce("_component", "id")).drop("_component")


def labelled(members: DataFrame, pattern: str = "CL%04d") -> DataFrame:
    """Adds cluster_id, cluster_size and confidence to rows with component, name and seq.

    Clusters are numbered by their first name.
    """
    clusters = members.groupBy("component").agg(F.min(F.struct(F.lower("name").alias("n"), F.col("seq").alias("s"))).alias("first"), F.count("*").alias("cluster_size"))
    ordered = numbered(clusters, "first", "component")
    return members.join(ordered.select("component", "cluster_size", F.format_string(pattern, "number").alias("cluster_id")), "component").withColumn(
        "confidence", F.when(F.col("cluster_size") > 1, 1.0).otherwise(0.0)
    )


def ungrouped(items: DataFrame, pattern: str = "CL%04d") -> DataFrame:
    """Clusters of one in scan order, for runs without grouping."""
    return numbered(items, "seq").withColumn("cluster_id", F.format_string(pattern, "number")).drop("number").withColumn("cluster_size", F.lit(1).cast("long")).withColumn("confidence", F.lit(0.0))


def duplicate_label(cluster_size: Column, label: Column) -> Column:
    """The label of groups; null for items on their own."""
    return F.when(cluster_size > 1, label)


def cluster_models(members: DataFrame) -> DataFrame:
    """One row per cluster: its ids in name order, the winner and the rejected ids; as long as the cluster."""
    by_name = F.struct(F.lower("file_name").alias("n"), "seq", F.col("photo_id").alias("id"))
    ids = lambda c: F.transform(F.array_sort(c), lambda x: x["id"])
    return members.groupBy("cluster_id").agg(
        ids(F.collect_list(by_name)).alias("photo_ids"), F.max(F.when(F.col("is_cluster_winner"), F.col("photo_id"))).alias("selected_photo_id"),
        ids(F.collect_list(F.when(F.col("status") == "rejected", by_name))).alias("rejected_photo_ids"), F.count("*").alias("size"),
    )


def bit_signature(values: Column) -> Column:
    """64 bits: which of 64 numbers exceed their median."""
    ordered = F.array_sort(values)
    median = (F.get(ordered, F.lit(31)) + F.get(ordered, F.lit(32))) / 2.0
    bits = F.transform(values, lambda v, i: F.when(v > median, F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(63) - i).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


#: Texts whose words are hashed together.
_TEXTS = 2048
SIMHASH_BITS = 60


class _WordHashes(dict):
    """The first 60 bits of the MD5 of words."""

    def __missing__(self, word: str) -> int:
        value = self[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big") >> 4
        return value


def _simhashes(texts: pa.Array) -> pa.Array:
    """Per text the bits that most of its distinct words have."""
    known, out = _WordHashes(), []
    for text in texts.to_pylist():
        words = dict.fromkeys(_BLANKS.split(text)) if text is not None else {}
        words.pop("", None)
        if not words:
            out.append(None)
            continue
        hashes = np.fromiter(map(known.__getitem__, words), "<u8", len(words))
        ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(len(words), 64).sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > len(words), bitorder="little").view("<i8")[0]) & ((1 << SIMHASH_BITS) - 1))
    return pa.array(out, pa.int64())


@F.arrow_udf(LongType())
def _simhash(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([_simhashes(texts[i : i + _TEXTS]) for i in range(0, len(texts), _TEXTS)] or [pa.array([], pa.int64())])


def simhash60(text: Column) -> Column:
    """60-bit similarity hash of the distinct lower-cased words of a text; null without words."""
    return _simhash(F.lower(text))
