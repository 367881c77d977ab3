"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Each class gets a mean and a covariance that is shrunk towards the pooled covariance and its
diagonal; the Cholesky factors are computed once and cached in the model. A score is the sigmoid of
the difference of the classes' Mahalanobis log-densities plus their log prior ratio.

Distribution: statistics are a projection in Arrow batches. Fitting needs, for each class, only
sums of values and of products, so it is one aggregation over every labelled row (no sample);
the model is a few hundred numbers at any size. Scoring is a projection again.

Defined cases: a null or empty text has statistics of 0 and gets a score like any other; a document
without a label takes no part in fitting; several labels of one document count as the lowest;
repeated rows each get a row; other columns are ignored. If a class has no labelled rows, the model
scores every document with the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, materialise, texts_as_bytes

#: What a document looks like, not how long it is: length alone says nothing about quality, and as a
#: feature it made the classifier reject short clean texts.
FEATURES = ("symbols", "capitals", "marks", "distinct_words", "digits", "long_words", "non_ascii", "stops")

#: Characters that prose seldom has, the usual marks, digits, capitals.
_SYMBOLS, _MARKS, _DIGITS = b"#*$%&|<>@^~{}[]\\/=+_", b".,;:!?'\"()-", b"0123456789"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NON_ASCII = bytes(range(128, 256))
#: Short function words of the corpus languages.
_STOPS = frozenset(
    b"the of and to in is that it for was with be on by this are as at from or an de la le et les des en un une du "
    b"que est pour dans qui par sur au der die und den von zu das mit sich auf ist im dem nicht ein eine als el y los "
    b"se del las por con no una su para es lo".split()
)


def features_of(raw: bytes) -> list[float]:
    """Statistics transformed to be roughly normal within a class; shares go through a square root."""
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    share = lambda found: (found / size) ** 0.5
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [
        share(count(_SYMBOLS)),
        share(count(_CAPITALS)),
        share(count(_MARKS)),
        len(set(words)) / n if n else 0.0,
        share(count(_DIGITS)),
        (sum(len(w) > 20 for w in words) / n) ** 0.5 if n else 0.0,
        share(count(_NON_ASCII)),
        (sum(map(_STOPS.__contains__, words)) / n) ** 0.5 if n else 0.0,
    ]


def features(text: Column | str) -> Column:
    """The statistics of a text as an array of double."""

    @F.arrow_udf("array<double>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([features_of(t) for t in texts_as_bytes(texts)], pa.list_(pa.float64()))

    return found(text)


@dataclass(frozen=True)
class Model:
    """Means, inverted Cholesky factors of the shrunk covariances and log-determinants, by class."""

    means: np.ndarray
    whiten: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray
    share: float
    fitted: bool = True
    names: tuple[str, ...] = field(default=FEATURES)

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = (x - self.means[k]) @ self.whiten[k].T
        return -0.5 * (np.einsum("ij,ij->i", z, z) + self.log_dets[k])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        gap = self.log_density(x, 1) - self.log_density(x, 0) + self.log_priors[1] - self.log_priors[0]
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fit_moments(n: np.ndarray, sums: np.ndarray, products: np.ndarray, alpha: float, gamma: float) -> Model:
    """From each class's count, sums and sums of products. alpha: weight of the pooled covariance;
    gamma: weight of its diagonal."""
    total, d = n.sum(), sums.shape[1]
    share = float(n[1] / total) if total else 0.5
    if (n < 2).any():
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), np.zeros(2), share, False)
    means = sums / n[:, None]
    scatter = products - n[:, None, None] * np.einsum("ki,kj->kij", means, means)
    pooled = scatter.sum(0) / max(total - 2, 1)
    floor = 1e-6 * np.eye(d)
    factors = np.empty((2, d, d))
    for k in (0, 1):
        own = (1 - alpha) * scatter[k] / max(n[k] - 1, 1) + alpha * pooled
        factors[k] = np.linalg.cholesky((1 - gamma) * own + gamma * np.diag(np.diag(own)) + floor)
    log_dets = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
    return Model(means, np.linalg.inv(factors), log_dets, np.log(n / total), share)


def lowest_labels(labels: DataFrame) -> DataFrame:
    """One quality label (0 or 1) for each doc_id that has one."""
    return (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
    )


def fit(stats: DataFrame, labels: DataFrame, alpha: float = 0.2, gamma: float = 0.1) -> Model:
    """stats: (doc_id, x). Uses all rows with a label; what reaches the driver is one row a class."""
    d = len(FEATURES)
    x = [F.element_at("x", i + 1) for i in range(d)]
    moments = [F.count(F.lit(1)).alias("n")]
    moments += [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    moments += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = stats.join(lowest_labels(labels), "doc_id").groupBy("quality").agg(*moments).collect()
    n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        k = int(r["quality"])
        n[k] = r["n"]
        for i in range(d):
            sums[k, i] = r[f"s{i}"]
            for j in range(i, d):
                products[k, i, j] = products[k, j, i] = r[f"p{i}_{j}"]
    return fit_moments(n, sums, products, alpha, gamma)


def score_features(x: Column | str, model: Model) -> Column:
    @F.arrow_udf("double")
    def scored(rows: pa.Array) -> pa.Array:
        values = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.array(model.score(values), pa.float64())

    return scored(x)


def score_text(text: Column | str, model: Model) -> Column:
    """The score straight from a text column, for filters that carry whole rows along."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        values = np.array([features_of(t) for t in texts_as_bytes(texts)]).reshape(-1, len(FEATURES))
        return pa.array(model.score(values), pa.float64())

    return scored(text)


def document_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, x), written out: a hundred bytes a document, read for fitting and for scoring."""
    return materialise(
        docs.select(F.col("doc_id").alias("doc_id"), features(F.col(text)).alias("x")), "quality-features"
    )


def training_rows(stats: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    return stats.where(crc_bucket("doc_id", folds) != held_out)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted; labels of held-out documents are never seen."""
    stats = document_features(docs, text)
    model = fit(training_rows(stats), labels)
    return stats.select(
        "doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), score_features("x", model).alias("score")
    ).select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
