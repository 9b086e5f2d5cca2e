"""Product-quantised vectors, with codebooks found by k-means under Drake and Hamerly's adaptive bounds.

Components become integers, vectors are cut into PARTS parts, and each part has a codebook of
at most ENTRIES entries that starts from the vectors of the smallest ids.  Every round assigns all parts to
their nearest entries and moves each entry to the floor of its parts' mean; all of it in exact integers.

With every vector its state is kept from round to round, in a written table: per part the assigned entry, the b
next closest entries with lower bounds of their distances in ascending order, and one
outer bound for all entries besides.  When entries have moved, each bound falls by its entry's
movement, the outer one by the largest.  The distance to the assigned entry is worked out; entries whose
bound lies above it cannot be nearer, so only those before are measured, and all only
where the outer bound fails too.  How many had to be measured is counted, and b is adapted to it for the next
round: doubled where the outer bound failed often, else cut to what nearly all parts needed.

Bounds and estimates are floating point and rounded to the safe side.  Entries that they cannot tell apart are
compared by exact integer distances, ties going to the lower index.  Integers of any
size are exact: beyond the range of 64 bits the same code runs on Python's integers.

Tasks add up their parts per entry, so sums leave them once per entry; codebooks (ENTRIES * dimension integers)
are all that passes the driver.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do vectors
of another dimension than most (of equally frequent ones the smaller counts).  A dimension that PARTS does not divide is
cut as evenly as can be.  Rows that repeat a vec_id are vectors of their own, ordered by components where the first
codebook takes them; rows without a vec_id come last there.  With fewer vectors than ENTRIES a codebook has an entry per
vector.  Null labels are one label.  An error beyond 64 bits is given as the largest long.  An empty
table has no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries whose bounds are kept per part at first, at least and at most.
NEIGHBOURS, LEAST, MOST = 16, 4, 64
_LONGEST = (1 << 63) - 1
#: Relative error that floating-point distances are taken to have.
_LOOSE = 1e-9
#: Labels with more than a 1024th of all rows are joined by broadcast: at most 1,024 of them.
_HOT_SHARE = 1024


def integers(x: np.ndarray, exact: bool) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers, or as Python integers where they may be larger."""
    x = x.astype(np.float64)
    if exact:
        return np.floor(x * SCALE).astype(np.int64)
    whole = np.abs(x) >= 2.0**53
    out = np.array([int(v) * SCALE if w else int(np.floor(v * SCALE)) for v, w in zip(x.ravel().tolist(), whole.ravel().tolist(), strict=True)], object)
    return out.reshape(x.shape)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise squared Euclidean distances, in the integers of x and y."""
    apart = x - y
    return (apart * apart).sum(axis=1) if x.shape[1] else np.zeros(len(x), x.dtype)


def _down(x: np.ndarray) -> np.ndarray:
    """As float32, never above."""
    x = np.minimum(x.astype(np.float64), 3e38).astype(np.float32)
    return np.nextafter(x, np.float32(-np.inf))


def _real(x: np.ndarray, unit: int) -> np.ndarray:
    """x / unit in floating point; huge integers divide without overflow."""
    return x.astype(np.float64) if unit == 1 else (x / unit).astype(np.float64)


def _root(x: np.ndarray, unit: int) -> np.ndarray:
    """Distances in units from squared ones."""
    return np.sqrt(_real(x, unit * unit))


@dataclass
class Near:
    """Per row the assigned entry, the next closest ones, and ascending bounds of theirs and of all others."""

    own: np.ndarray
    ids: np.ndarray
    low: np.ndarray

    def packed(self) -> np.ndarray:
        return np.concatenate([self.own[:, None].astype(np.uint8), self.ids.astype(np.uint8), np.ascontiguousarray(self.low, "<f4").view(np.uint8).reshape(len(self.own), -1)], axis=1)

    @classmethod
    def unpacked(cls, data: np.ndarray, b: int) -> Near:
        return cls(data[:, 0].astype(np.int64), data[:, 1 : 1 + b].astype(np.int64), np.ascontiguousarray(data[:, 1 + b :]).view("<f4").astype(np.float64))

    def resized(self, b: int) -> Near:
        """b entries a row: the bound of what is left out is the outer one; missing ones repeat the assigned entry."""
        have = self.ids.shape[1]
        if have >= b:
            return Near(self.own, self.ids[:, :b], self.low[:, : b + 1])
        more = b - have
        return Near(self.own, np.concatenate([self.ids, np.repeat(self.own[:, None], more, axis=1)], axis=1), np.concatenate([self.low, np.repeat(self.low[:, -1:], more, axis=1)], axis=1))


def _least(rows: np.ndarray, ids: np.ndarray, measured: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row (0 to n - 1 all occur, ascending) the id of the least measure, the lower id of equal ones, and the measure."""
    begins = np.searchsorted(rows, np.arange(n))
    least = np.minimum.reduceat(measured, begins)
    return np.minimum.reduceat(np.where(measured == least[rows], ids, len(rows) + (1 << 30)), begins), least


def _all_measured(x: np.ndarray, entries: np.ndarray, b: int, unit: int) -> tuple[np.ndarray, np.ndarray, Near]:
    """Nearest entries, exact distances and fresh bounds from all entries."""
    xf, ef = _real(x, unit), _real(entries, unit)
    x2, e2 = (xf * xf).sum(axis=1), (ef * ef).sum(axis=1)
    rough = np.maximum(x2[:, None] - 2 * (xf @ ef.T) + e2, 0)
    error = _LOOSE * (x2 + e2.max())
    rows, ids = np.nonzero(rough <= (rough.min(axis=1) + 2 * error)[:, None])  # what the estimates cannot tell apart
    own, exact = _least(rows, ids, distances(x[rows], entries[ids]), len(x))
    keep = min(b + 2, len(entries))
    near = np.argpartition(rough, keep - 1, axis=1)[:, :keep]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(rough, near, axis=1), axis=1), axis=1)
    bounds = _down(np.sqrt(np.maximum(np.take_along_axis(rough, near, axis=1) - error[:, None], 0)))
    place = np.argmax(near == own[:, None], axis=1)
    place[near[np.arange(len(x)), place] != own] = keep - 1  # one of many equal entries: the last of those kept makes room
    others = np.arange(keep) != place[:, None]
    ids, low = near[others].reshape(len(x), -1), bounds[others].reshape(len(x), -1)
    if keep == len(entries):
        low = np.concatenate([low, np.full((len(x), 1), np.inf)], axis=1)
    else:
        ids = ids[:, :-1]  # its bound is the outer one
    return own, exact, Near(own, ids, low).resized(b)


def assigned(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, near: Near | None, b: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray, Near, np.ndarray]:
    """Nearest entries of the rows of x, exact distances, the new state and how many entries each row had to measure.

    `moved` holds how far entries have moved since `near`, rounded up; without `near` all are measured.
    """
    if near is None or not len(x):
        own, exact, near = _all_measured(x, entries, b, unit) if len(x) else (np.zeros(0, np.int64), x[:, :0].sum(axis=1), Near(np.zeros(0, np.int64), np.zeros((0, b), np.int64), np.zeros((0, b + 1))))
        return own, exact, near, np.full(len(x), len(entries))
    have = near.ids.shape[1]
    own, ids, low = near.own.copy(), near.ids.copy(), near.low.copy()
    low[:, :have] -= moved[ids]
    low[:, have] -= moved.max()
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
    exact = distances(x, entries[own])
    up = _root(exact, unit) * (1 + _LOOSE) + _LOOSE
    need = (low <= up[:, None]).sum(axis=1)
    some = np.flatnonzero((need > 0) & (need <= have))
    if len(some):
        at, place = np.nonzero(np.arange(have) < need[some, None])
        rows = some[at]
        other = ids[rows, place]
        measured = distances(x[rows], entries[other])
        low[rows, place] = _root(measured, unit) * (1 - _LOOSE)
        best, least = _least(at, other, measured, len(some))
        nearer = (least < exact[some]) | ((least == exact[some]) & (best < own[some]))
        swap = some[nearer]
        place = np.argmax(ids[swap] == best[nearer, None], axis=1)
        ids[swap, place], low[swap, place] = own[swap], _root(exact[swap], unit) * (1 - _LOOSE)
        own[swap], exact[swap] = best[nearer], least[nearer]
        order = np.argsort(low[some, :have], axis=1)
        ids[some] = np.take_along_axis(ids[some], order, axis=1)
        low[some, :have] = np.take_along_axis(low[some, :have], order, axis=1)
        low[some] = np.minimum.accumulate(low[some, ::-1], axis=1)[:, ::-1]
    state = Near(own, ids, low).resized(b)
    whole = np.flatnonzero(need > have)
    if len(whole):
        own[whole], exact[whole], fresh = _all_measured(x[whole], entries, b, unit)
        state.own[whole], state.ids[whole], state.low[whole] = fresh.own, fresh.ids, fresh.low
    return own, exact, state, np.where(need > have, len(entries), need)


def adapted(b: int, visits: np.ndarray) -> int:
    """The next b, from counts of parts by the number of entries they had to measure (the last count: all)."""
    total, failed = visits.sum(), visits[-1]
    if failed * 10 > total:
        return min(MOST, 2 * b)
    enough = np.searchsorted(np.cumsum(visits[:-1]), 0.99 * (total - failed))
    return int(min(MOST, max(LEAST, enough)))


@dataclass(frozen=True)
class Codes:
    """rows: vec_id, label, codes (a byte per part), error; codebooks[part][entry] in Python integers."""

    rows: DataFrame
    codebooks: list[list[list[int]]]
    #: How many neighbours were kept after each round, and how many parts measured 0, 1, ... or all entries in it.
    history: list[tuple[int, list[int]]]


def _limbs(sums: np.ndarray, n: int) -> np.ndarray:
    """Integers as n limbs, 32 bits each but for the last one, which is signed and takes the rest."""
    out = []
    for _ in range(n - 1):
        out.append((sums & 0xFFFFFFFF).astype(np.int64))
        sums = sums >> 32
    return np.stack([*out, sums.astype(np.int64)], axis=-1)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _round(rows: DataFrame, books: list[np.ndarray], moved: list[np.ndarray], edges: list[int], exact: bool, unit: int, had: int | None, b: int, limbs: int, last: bool) -> DataFrame:
    """Assigns all parts.  Besides the rows, with state, codes and error, each task gives a row of sums per entry that it met.

    The slots of sums are part * entries + entry, with the count behind the components; slot -1 counts parts by entries measured.
    """
    k = len(books[0])
    width = max(book.shape[1] for book in books)
    kind = np.int64 if exact else object

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books), k, width + 1), kind)
        visits, label_kind, vector_kind = np.zeros(k + 1, np.int64), label_type, vector_type
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            label_kind, vector_kind = batch.column(1).type, batch.column(2).type
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            x = integers(flat, exact)
            packed, codes, error = [], np.empty((n, len(books)), np.uint8), np.zeros(n, kind)
            if had is not None:
                stored = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, len(books), -1)
            for p, book in enumerate(books):
                part = x[:, edges[p] : edges[p + 1]]
                near = Near.unpacked(stored[:, p], had) if had is not None else None
                own, apart, state, need = assigned(part, book, moved[p], near, b, unit)
                codes[:, p] = own
                error = error + apart
                visits += np.bincount(need, minlength=k + 1)
                if not last:
                    packed.append(Near(state.own, state.ids, _down(state.low)).packed())
                    np.add.at(sums[p, :, :-1], own, np.pad(part, ((0, 0), (0, width - part.shape[1]))))
                    sums[p, :, -1] += np.bincount(own, minlength=k)
            state = [s.tobytes() for s in np.concatenate(packed, axis=1)] if not last else [None] * n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(state, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.minimum(error, _LONGEST).astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))],
                ["vec_id", "label", "v", "near", "codes", "error", "slot", "sums"],
            )
        if not last:
            flat = sums.reshape(len(books) * k, width + 1)
            slots = np.flatnonzero(flat[:, -1] > 0)
            n, values = len(slots) + 1, [*_limbs(flat[slots], limbs).reshape(len(slots), (width + 1) * limbs), visits]
            columns = [pa.nulls(n, t) for t in (pa.int64(), label_kind, vector_kind, pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([*slots, -1], pa.int32()), pa.array(values, pa.list_(pa.int64()))], ["vec_id", "label", "v", "near", "codes", "error", "slot", "sums"])

    from pyspark.sql.pandas.types import to_arrow_type

    label, vector = rows.schema["label"].dataType, rows.schema["v"].dataType
    label_type, vector_type = to_arrow_type(label), to_arrow_type(vector)
    return rows.select("vec_id", "label", "v", "near").mapInArrow(
        assign, f"vec_id long, label {label.simpleString()}, v {vector.simpleString()}, near binary, codes binary, error long, slot int, sums array<long>"
    )


def _totals(frame: DataFrame, slots: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over tasks per slot and place, and the counts of slot -1; as many values as the codebooks have, whatever the table's rows."""
    out, visits = np.zeros((slots, size), np.int64), {}
    found = frame.filter("slot is not null").select("slot", F.posexplode("sums").alias("place", "value")).groupBy("slot", "place").agg(F.sum("value").alias("value"))
    for slot, place, value in found.collect():
        if slot < 0:
            visits[place] = value
        else:
            out[slot, place] = value
    return out, np.array([visits[i] for i in range(len(visits))])


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, neighbours: int = NEIGHBOURS) -> Codes:
    """Codes and errors of the rows of vectors (vec_id, embedding, label), and the codebooks."""
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<float>" if element == "float" else "array<double>").alias("v")).filter(_usable(F.col("v")))
    sizes = kept.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))).cast("double").alias("top"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    dim, n, top = (most["size"], most["n"], most["top"]) if most else (0, 0, 0.0)
    edges = [dim * p // parts for p in range(parts + 1)]
    largest = (int(top) + 1) * SCALE
    exact = dim * (2 * largest) ** 2 * 4 < 1 << 62 and n * largest < 1 << 62
    unit = 1 if exact else 1 << max(0, largest.bit_length() - 60)
    limbs = 1 if exact else (n * largest).bit_length() // 32 + 2
    rows = kept.filter(F.size("v") == dim).withColumn("near", F.lit(None).cast("binary"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).toArrow().column("v")
    if not len(first):
        return Codes(kept.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), [[] for _ in range(parts)], [])
    start = integers(first.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(first), dim), exact)
    books = [start[:, x:y] for x, y in itertools.pairwise(edges)]
    k, width = len(start), max(book.shape[1] for book in books)
    moved, had, b, history, held = [np.zeros(k)] * parts, None, min(neighbours, k - 1), [], None
    for _ in range(rounds):
        stored = scratch.keep(_round(rows, books, moved, edges, exact, unit, had, b, limbs, False))
        if held is not None:
            scratch.drop(held)
        held, rows, had = stored, stored.filter("slot is null"), b
        totals, visits = _totals(stored, parts * k, (width + 1) * limbs)
        limbed = totals.reshape(parts, k, width + 1, limbs).astype(object)
        sums = sum(limbed[..., i] << (32 * i) for i in range(limbs))
        fresh = [book.copy() for book in books]
        for p, e in zip(*np.nonzero(sums[..., -1] > 0), strict=True):
            fresh[p][e] = [s // sums[p, e, -1] for s in sums[p, e, : books[p].shape[1]]]
        moved = [_root(distances(was, now), unit) * (1 + _LOOSE) + _LOOSE for was, now in zip(books, fresh, strict=True)]
        books = fresh
        history.append((b, visits.tolist()))
        b = min(adapted(b, visits), k - 1)
    done = _round(rows, books, moved, edges, exact, unit, had, b, limbs, True)
    return Codes(done.select("vec_id", "label", "codes", "error"), [[[int(v) for v in e] for e in book] for book in books], history)


def codebooks_digest(codebooks: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in codebooks for entry in book for v in entry).encode()).hexdigest()


def code_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 per usable vector."""
    found = vector_codes(vectors)
    rows = Scratch(vectors.sparkSession).keep(found.rows)
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
    sums = sums.select(F.col("label").alias("of"), F.least("sum", F.lit(_LONGEST)).cast("long").alias("label_error"), "n")
    least = rows.count() // _HOT_SHARE
    hot = sums.filter(F.col("n") > least).withColumn("is_hot", F.lit(True)).drop("n")
    cold = sums.filter(F.col("n") <= least).select(F.col("of").alias("rare"), F.col("label_error").alias("rare_error"))
    marked = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("of")), "left")
    plain = marked.filter("is_hot").select("vec_id", "codes", "error", "label_error")
    rest = marked.filter("is_hot is null").join(cold, F.col("label").eqNullSafe(F.col("rare"))).select("vec_id", "codes", "error", F.col("rare_error").alias("label_error"))
    return plain.unionByName(rest).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks_digest(found.codebooks)).alias("codebooks_sha256"))
