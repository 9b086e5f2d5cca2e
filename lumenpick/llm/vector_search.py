"""Approximate nearest neighbours: inverted lists with product-quantised residuals and exact reranking.

Coarse centroids and codebooks are fitted on the driver on a sample of at most
TRAIN_ROWS vectors, in blocks of FIT_ROWS; every vector is indexed.  A vector belongs to the list of its nearest
centroid, and its residual is coded by one codeword per subspace.  Neighbouring lists make up groups of
even size, long lists are split over several, and queries are dealt into slices.  A slice goes to the
groups that hold a list that it probes (a query probes the PROBE_SHARE of lists whose centroids have the largest inner
products); a group and a slice meet in a cell, which is one task's work and holds CELL_BYTES of vectors at most.
There, the products of queries with the vectors as their codes tell them estimate inner products, block by block.
Every vector keeps the norm of its quantisation error; those whose estimate plus
SLACK standard errors reaches the k-th best so far are scored exactly, so a dense
cluster that the codes can't tell apart is reranked whole.  Only the best k per query leave a cell.
Queries that found fewer than k in their lists visit all of them.

Equal vectors collapse to one entry that remembers its k + 1 smallest ids, for
queries and candidates alike, so a vector repeated countless times costs one search.

Defined results: vectors that are null, zero, hold null or non-finite components
or have another dimension than most take no part.  Without any valid vector the
result is empty.  Rows that repeat a vec_id with one vector count once; rows without a vec_id take no
part.  Columns of floats keep their precision, all others are searched as doubles.  Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, bound_batches

NEIGHBOURS = 20
QUERY_STEP = 20
TRAIN_ROWS = 20_000
MAX_LISTS = 1024
#: Rows of a matrix of distances that the fit works out at once.
FIT_ROWS = 2048
#: Vectors and queries whose products a task works out at once.
BLOCK_ROWS = 2048
TILE_QUERIES = 256
#: Bytes of vectors in a group, and in a slice of queries; cells that there are at least.
CELL_BYTES = 32 << 20
CELLS = 18
PROBE_SHARE = 0.8
#: Standard errors of an estimate that reranking allows for.
SLACK = 3.0
SUBVECTOR = 4
CODEWORDS = 256
#: Rows of one vector up to which they are one task's work, if that is more than a 64th of all and 256.
LARGE_CLASS = 1 << 16
_SALTS = 64


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centre; the matrix of distances never has more than FIT_ROWS rows."""
    norms, turned = (centers**2).sum(axis=1), centers.T
    return np.concatenate([np.zeros(0, np.int64), *[np.argmin(norms - 2 * (x[a : a + FIT_ROWS] @ turned), axis=1) for a in range(0, len(x), FIT_ROWS)]])


@dataclass(frozen=True)
class Quantiser:
    centers: np.ndarray
    codebooks: list[np.ndarray]
    edges: list[tuple[int, int]]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 7) -> Quantiser:
        centers = _kmeans(sample, lists, seed)
        residual = sample - centers[_nearest(sample, centers)]
        dim = sample.shape[1]
        edges = [(i, min(dim, i + SUBVECTOR)) for i in range(0, dim, SUBVECTOR)]
        return cls(centers, [_kmeans(residual[:, a:b], CODEWORDS, seed + a + 1) for a, b in edges], edges)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and norm of the quantisation error of each vector."""
        near = _nearest(x, self.centers)
        residual = x - self.centers[near]
        codes = [_nearest(residual[:, a:b], book) for (a, b), book in zip(self.edges, self.codebooks, strict=True)]
        left = residual - np.concatenate([book[c] for c, book in zip(codes, self.codebooks, strict=True)], axis=1)
        return near, np.stack(codes, axis=1).astype(np.uint8), np.sqrt((left**2).sum(axis=1))

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """Which lists each query visits, as a boolean matrix."""
        scores = queries @ self.centers.T
        out = np.zeros(scores.shape, bool)
        np.put_along_axis(out, np.argpartition(-scores, probes - 1, axis=1)[:, :probes], True, axis=1)
        return out

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors as lists and codes tell them."""
        return self.centers[lists] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.codebooks)], axis=1)


def exact_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in one fixed order."""
    return (queries * vectors).sum(axis=-1)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _classes(vectors: DataFrame, dim: int, k: int, kind: str, query_step: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """class (smallest vec_id), vector (packed), ids: the k + 1 smallest ids that have the vector, asked: whether a query has it; and query_id, class of all queries.

    Rows with one vector meet in one task, those of the few most frequent ones first in _SALTS parts.
    """
    valid = vectors.filter("vec_id is not null").filter(
        (F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    )

    def pack(batch: pa.RecordBatch) -> dict:
        flat = _column(batch, "embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim) + np.zeros(1, kind)  # no negative zeros
        return {"vec_id": _column(batch, "vec_id"), "vector": [row.tobytes() for row in flat]}

    packed = arrow_map(valid.select("vec_id", "embedding"), pack, "vec_id long, vector binary")
    sizes = packed.groupBy(F.xxhash64("vector").alias("hash")).agg(F.count("*").alias("n"))
    most = max(256, min(LARGE_CLASS, vectors.count() // 64))
    large = [r["hash"] for r in sizes.filter(F.col("n") > most).select("hash").collect()]  # at most 64, or a LARGE_CLASS-th of all
    is_large = F.xxhash64("vector").isin(large) if large else F.lit(False)
    salt = F.when(is_large, F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS))).otherwise(-1)
    # one shuffle of the vectors: all that follows keeps to its partitions
    dealt = packed.withColumn("salt", salt).repartition("vector", "salt").distinct()
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("vector", "salt").orderBy("vec_id"))).withColumn("asks", F.col("vec_id") % query_step == 0)
    kept = some.filter((F.col("rank") <= k + 1) | F.col("asks")).groupBy("vector", "salt").agg(
        F.min("vec_id").alias("class"), F.collect_list(F.when(F.col("rank") <= k + 1, F.col("vec_id"))).alias("ids"), F.collect_list(F.when(F.col("asks"), F.col("vec_id"))).alias("queries")
    )
    kept = scratch.keep(kept.withColumn("ids", F.sort_array("ids")))
    own, parts = kept.filter("salt < 0"), kept.filter("salt >= 0")
    classes, members = own.select("class", "vector", "ids", (F.size("queries") > 0).alias("asked")), own.select(F.explode("queries").alias("query_id"), "class")
    if large:
        whole = parts.groupBy("vector").agg(F.min("class").alias("class"), F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.bool_or(F.size("queries") > 0).alias("asked"))
        whole = scratch.keep(whole.select("class", "vector", "ids", "asked"))
        asking = parts.select("vector", F.explode("queries").alias("query_id")).join(F.broadcast(whole.select("vector", "class")), "vector")  # a row per large class
        classes, members = classes.unionByName(whole), members.unionByName(asking.select("query_id", "class"))
    return classes, members


def _dealt(sizes: np.ndarray, order: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Per list its first group and over how many it is split: groups of even size, lists in the given order."""
    most = max(1, -(-int(sizes.sum()) // groups))
    first, pieces = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    filled = np.cumsum(sizes[order])
    first[order] = (filled - sizes[order]) // most
    return np.minimum(first, groups - 1), np.minimum(pieces, groups - np.minimum(first, groups - 1))


def _grid(rows: int, queries: int, row_bytes: int, cells: int) -> tuple[int, int]:
    """Groups of rows and slices of queries: enough cells, none with more than CELL_BYTES of either, and as few bytes to be sent as that allows."""
    groups, slices = (max(1, -(-n * row_bytes // CELL_BYTES)) for n in (rows, queries))
    options = [(max(groups, -(-cells // s)), s) for s in range(slices, slices + cells)]
    return min(options, key=lambda o: o[1] * rows + o[0] * 2 * queries)  # a query's best rows weigh about as much as its vector


def nearest_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, query_step: int = QUERY_STEP, probe_share: float = PROBE_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: per row with vec_id % query_step == 0 its k nearest other rows by inner product."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    sizes = vectors.groupBy(F.size("embedding").alias("dim")).count().filter("dim > 0").orderBy(F.desc("count"), "dim").head()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dim, kind = sizes["dim"], "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    vectors = vectors.select("vec_id", "embedding") if kind == "<f4" else vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    classes, members = _classes(vectors, dim, k, kind, query_step, scratch)
    total = classes.count()
    if not total:
        return empty
    sample = _sample(classes, total).collect()
    sample = np.frombuffer(b"".join(bytes(r["vector"]) for r in sample), kind).reshape(-1, dim).astype(float)
    model = Quantiser.fit(sample, max(4, min(MAX_LISTS, int(total**0.5) // 2)))
    shared = spark.sparkContext.broadcast(model)  # MAX_LISTS centroids and CODEWORDS codewords per subspace at most
    lists = len(model.centers)
    probes = min(lists, max(1, int(np.ceil(lists * probe_share))))

    near = arrow_map(classes.select("vector"), lambda b: {"list": shared.value.encode(_matrix(_column(b, "vector"), kind, dim).astype(float))[0].astype(np.int32)}, "list int")
    counts = np.zeros(lists, np.int64)
    for row in near.groupBy("list").count().collect():  # a row per list
        counts[row["list"]] = row["count"]
    asked = classes.filter("asked").select("class", "vector")
    # neighbouring lists fill a group together, large ones are split
    axis = np.linalg.svd(model.centers - model.centers.mean(axis=0), full_matrices=False)[2][0]
    order = np.argsort(model.centers @ axis, kind="stable")
    search = lambda queries, visited: _found(queries, classes.select("class", "vector"), shared, counts, order, total, visited, k, kind, dim)
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "class")
    found = scratch.keep(search(asked, probes).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place"))
    reached = found.join(classes.select("class", F.size("ids").alias("n")), "class").groupBy("asked").agg(F.sum("n").alias("n")).filter(F.col("n") > k).select("asked")
    short = scratch.keep(asked.join(reached.withColumnRenamed("asked", "class"), "class", "left_anti"))
    if probes < lists and not short.isEmpty():
        again = search(short, lists).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
        found = scratch.keep(found.join(short.select(F.col("class").alias("asked")), "asked", "left_anti").unionByName(again))
    candidates = found.join(classes.select("class", "ids"), "class").select("asked", "score", F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    candidates = scratch.keep(candidates.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k + 1).drop("place"))
    paired = members.withColumnRenamed("class", "asked").join(candidates, "asked").filter("query_id <> vec_id")
    ranked = paired.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _sample(classes: DataFrame, total: int) -> DataFrame:
    """The vectors of the TRAIN_ROWS classes with the smallest hashes.

    Hashes beyond a bound that half as many again stay below are left out by the tasks, else each task sends TRAIN_ROWS
    candidates to the driver.
    """
    key = F.xxhash64("class")
    bound = -(2**63) + int(2**64 * min(1.0, 1.5 * TRAIN_ROWS / total))
    low = classes.filter(key < F.lit(bound)) if bound < 2**63 else classes
    return low.orderBy(key, "class").limit(TRAIN_ROWS).select("vector")


def _found(asked: DataFrame, stored: DataFrame, shared, counts: np.ndarray, order: np.ndarray, total: int, probes: int, k: int, kind: str, dim: int) -> DataFrame:
    """asked, class, score: the k + 1 best of each cell per query that visits it."""
    queries, spark = asked.count(), asked.sparkSession
    groups, slices = _grid(total, queries, dim * np.dtype(kind).itemsize, max(CELLS, 3 * spark.sparkContext.defaultParallelism))
    first, pieces = _dealt(counts, order, groups)
    holds = np.zeros((len(counts), groups), np.float32)
    for listed in range(len(counts)):
        holds[listed, first[listed] : first[listed] + pieces[listed]] = 1

    def mixed(ids: np.ndarray) -> np.ndarray:
        """Evenly spread non-negative numbers."""
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

    def store(batches):
        """Vectors with list, codes and error, for every slice of their group."""
        for batch in batches:
            ids = _column(batch, "class").to_numpy()
            near, codes, errors = shared.value.encode(_matrix(_column(batch, "vector"), kind, dim).astype(float))
            group = first[near] + mixed(ids) % pieces[near]
            for piece in range(slices):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((group * slices + piece).astype(np.int32)), _column(batch, "class"), _column(batch, "vector").cast(pa.binary()), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)],
                    ["cell", "class", "vector", "list", "codes", "error"],
                )

    def send(batches):
        """Queries for the groups that hold a list that they probe."""
        for batch in batches:
            q = _matrix(_column(batch, "vector"), kind, dim).astype(float)
            rows, group = np.nonzero(shared.value.probed(q, probes).astype(np.float32) @ holds)
            piece = mixed(_column(batch, "class").to_numpy()) // groups % slices
            to = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array((group * slices + piece[rows]).astype(np.int32)), _column(to, "class"), _column(to, "vector").cast(pa.binary())], ["cell", "class", "vector"])

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, near, errors = (rows[c].to_numpy() for c in ("class", "list", "error"))
        x, codes = _matrix(rows["vector"], kind, dim), _matrix(rows["codes"], np.uint8, len(shared.value.edges))
        names, q = queries["class"].to_numpy(), _matrix(queries["vector"], kind, dim).astype(float)
        visits = shared.value.probed(q, probes) if len(q) else np.zeros((0, len(counts)), bool)
        slack = SLACK * np.sqrt((q**2).sum(axis=1, keepdims=True) / dim)
        scores, found = np.full((len(q), k + 1), -np.inf), np.full((len(q), k + 1), np.iinfo(np.int64).max)
        for a in range(0, len(x) if len(q) else 0, BLOCK_ROWS):
            block = slice(a, a + BLOCK_ROWS)
            vectors = x[block].astype(float)
            # one product gives the estimate and the slack
            told = np.ascontiguousarray(np.concatenate([shared.value.decoded(near[block], codes[block]), errors[block, None]], axis=1).T)
            for t in range(0, len(q), TILE_QUERIES):
                tile = slice(t, t + TILE_QUERIES)
                best = _better(q[tile], slack[tile], visits[tile][:, near[block]], vectors, told, ids[block], scores[tile], found[tile], k)
                if best is not None:
                    scores[tile], found[tile] = best
        there, _ = np.nonzero(np.isfinite(scores))
        return pa.table({"asked": pa.array(names[there], pa.int64()), "class": pa.array(found[np.isfinite(scores)], pa.int64()), "score": pa.array(scores[np.isfinite(scores)], pa.float64())})

    cells = groups * slices
    bound_batches(spark)
    left = stored.mapInArrow(store, "cell int, class long, vector binary, list int, codes binary, error double").repartitionById(cells, "cell")
    right = asked.mapInArrow(send, "cell int, class long, vector binary").repartitionById(cells, "cell")
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, "asked long, class long, score double")


def _better(q: np.ndarray, slack: np.ndarray, visited: np.ndarray, x: np.ndarray, told: np.ndarray, ids: np.ndarray, scores: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The k + 1 best scores and ids per query of those so far and a block's; None if they stay as they are."""
    worth = ~(np.concatenate([q, slack], axis=1) @ told < scores[:, k, None]) & visited  # what overflows is scored
    if np.count_nonzero(worth) * 24 > worth.size and len(x) > k + 1:
        # too many to score one by one: those clearly below the block's own k-th best go first
        rough = np.where(worth, q @ x.T, -np.inf)
        least = np.partition(rough, len(x) - k - 1, axis=1)[:, len(x) - k - 1]
        with np.errstate(invalid="ignore"):
            least = least - 1e-9 * np.sqrt((q**2).sum(axis=1) * (x**2).sum(axis=1).max())  # more than rounding can be
        worth &= ~(rough < least[:, None])
    rows, cols = np.divmod(np.flatnonzero(worth), worth.shape[1])
    if not len(rows):
        return None
    n = len(q)
    row = np.concatenate([np.repeat(np.arange(n), k + 1), rows])
    score = np.concatenate([scores.ravel(), exact_products(q[rows], x[cols])])
    entry = np.concatenate([found.ravel(), ids[cols]])
    order = np.lexsort((entry, -score, row))
    starts = np.searchsorted(row[order], np.arange(n))
    best = order[starts[:, None] + np.arange(k + 1)]
    return score[best], entry[best]
