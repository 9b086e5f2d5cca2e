"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a row of transformed statistics (quality_features).  Per
class, Spark sums counts, first and second moments over all labelled training
rows; the driver receives only those sums, whose size depends on the number of
statistics and not on the data.  Class covariances of the standardised
statistics are shrunk towards the pooled unit scale, factored once (Cholesky),
and a score is the logistic of the difference of the two log-densities, i.e. of
halved Mahalanobis distances and log-determinants.

Filtering reads the texts twice, of which the first time only labelled ones: one
Arrow function takes a text to its score, so each text crosses to Python once and the
rows themselves stay in the JVM.

Defined results: null and empty texts are scored like any text (their
statistics are all zero); documents without a label are scored and never used
for fitting; labels other than 0 and 1 are ignored; several label rows for one
document count as the largest of them.  Without training rows of both classes every score
is 0.5.  Repeated document rows are scored once each; rows without a doc_id are scored
like any others and never used for fitting.  Extra columns are ignored by score_documents
and pass through keep_good_documents, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Scratch, arrow_map
from .quality_features import FEATURES, document_features

#: Weight of the unit matrix in each class covariance of standardised statistics.
SHRINKAGE = 0.15
#: A document is predicted good from this score on.
THRESHOLD = 0.7
#: Texts whose statistics are held at a time.
_ROWS = 256


def is_held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4) == 2


def feature_table(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of docs beside `stats`, the document statistics of `text`."""
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(batch.schema.get_field_index("text"))
        rows = [document_features(t.as_py()) for t in texts]
        flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
        return {c: batch.column(batch.schema.get_field_index(c)) for c in columns} | {"stats": pa.ListArray.from_arrays(offsets, flat)}

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", stats array<double>"
    return arrow_map(docs.select(*columns, "text"), run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Standardisation, and per class the mean, the inverse Cholesky factor and the log-density constant."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.center) / self.scale
        density = [
            c - 0.5 * np.square((z - m) @ f.T).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def from_moments(moments: dict[int, np.ndarray], shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """moments: per class count, sums and sums of products, flattened; None unless both classes occur."""
    p = len(FEATURES)
    if any(c not in moments or moments[c][0] < 1 for c in (0, 1)):
        return None
    n = {c: moments[c][0] for c in (0, 1)}
    total = moments[0] + moments[1]
    center = total[1 : p + 1] / total[0]
    spread = np.sqrt(np.maximum(np.diag(total[p + 1 :].reshape(p, p)) / total[0] - center**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, factors, constants = [], [], []
    for c in (0, 1):
        mean = moments[c][1 : p + 1] / n[c]
        cov = (moments[c][p + 1 :].reshape(p, p) / n[c] - np.outer(mean, mean)) / np.outer(scale, scale)
        lower = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * np.eye(p))
        means.append((mean - center) / scale)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(n[c] / total[0]) - np.log(np.diag(lower)).sum()))
    return Discriminant(center, scale, tuple(means), tuple(factors), tuple(constants))


def class_moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Sum of (1, x, x xT) per class over columns (quality, stats); map-side sums, then one Spark aggregate per entry."""
    p = len(FEATURES)
    width = 1 + p + p * p

    def partial(batches):
        sums = {0: np.zeros(width), 1: np.zeros(width)}
        for batch in batches:
            quality = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(quality), p)
            for c in (0, 1):
                part = x[quality == c]
                sums[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        for c in (0, 1):
            yield pa.RecordBatch.from_pydict({"quality": pa.array(np.full(width, c, np.int32)), "entry": pa.array(np.arange(width, dtype=np.int32)), "value": pa.array(sums[c])})

    rows = labelled.select("quality", "stats").mapInArrow(partial, "quality int, entry int, value double")
    out: dict[int, np.ndarray] = {}
    for row in rows.groupBy("quality", "entry").agg(F.sum("value").alias("value")).collect():
        out.setdefault(row["quality"], np.zeros(width))[row["entry"]] = row["value"]
    return out


def training_marks(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the documents with a label that are not held out."""
    return (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )


def fit_quality(stats: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """Fit on the rows of stats (doc_id, stats) that have a label and are not held out."""
    return from_moments(class_moments(stats.join(training_marks(labels), "doc_id").select("quality", "stats")), shrinkage)


def add_scores(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """Replace `stats` by `score` and `predicted`."""
    keep = [c for c in stats.columns if c != "stats"]
    kinds = dict(stats.dtypes)
    p = len(FEATURES)

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array(batch.column(batch.schema.get_field_index("stats")).to_pylist(), float).reshape(-1, p)
        return {c: batch.column(batch.schema.get_field_index(c)) for c in keep} | {"score": pa.array(model.score(x))}

    if model is None:
        scored = stats.drop("stats").withColumn("score", F.lit(0.5))
    else:
        scored = arrow_map(stats, run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    scratch = Scratch(docs.sparkSession)
    stats = scratch.keep(feature_table(docs, ["doc_id"]))
    scored = add_scores(stats, fit_quality(stats, labels, shrinkage))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def score_column(text: Column, model: Discriminant | None) -> Column:
    """The score of a text column, features and densities in one Arrow function."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf(DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.concat_arrays([pa.array(model.score(np.stack([document_features(t.as_py()) for t in batch[i : i + _ROWS]]))) for i in range(0, len(batch), _ROWS)] or [pa.array([], pa.float64())])

    return scores(text)


def keep_good_documents(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> DataFrame:
    """The document rows predicted good, with all their columns."""
    marks = training_marks(labels)
    training = docs.select("doc_id", "text").join(marks, "doc_id").select("quality", "text")
    model = from_moments(class_moments(feature_table(training, ["quality"])), shrinkage)
    return docs.filter(score_column(F.col("text"), model) >= THRESHOLD)
