"""Quality classifier: a regularised quadratic discriminant on document statistics.

Every document becomes ``FEATURES`` numbers: shares and ratios of its bytes,
words and lines on a log scale. Each class is a normal distribution with its own
mean and covariance; covariances are shrunk towards the pooled one and towards
its diagonal. The score is the posterior of class 1, from the difference of the
two log densities, whose Mahalanobis distances use Cholesky factors computed
once; the log odds are tempered.

Learning reads sums that Spark adds up over all labelled rows of the training
folds; the driver sees ``2 * (1 + d + d * d)`` numbers whatever the corpus size.

Cases: a null text counts as empty; an empty text has features of its own and is
scored like any other; a null ``doc_id`` is never labelled and not held out;
labels that are null are left out; with no labelled rows of one class every
score is the share of class 1 among the rest (1 with no labels at all); repeated
rows score alike; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import settled, tidied

FEATURES = (
    "words", "word_length", "upper", "digits", "symbols", "marks", "lines",
    "variety", "top_word", "doubled_words", "repeated_lines", "packed",
)
THRESHOLD = 0.3
FOLDS = 5
POOLED, DIAGONAL = 0.3, 0.05  # shares of the pooled covariance and of its diagonal in each class covariance
TEMPER = 4.0  # correlated statistics make the plain posterior too sure; log odds are divided by this
FLOOR = 1e-3  # added to shares before the logarithm

_CLASS = np.zeros(256, np.intp)
for _k, _bytes in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*+/<=>@\\^_`{|}~!", b".,;:?'\"()-[]", b"\n"), 1
):
    _CLASS[list(_bytes)] = _k


def statistics(text: str | None) -> list[float]:
    """The features of one whole text."""
    data = (text or "").encode()
    words = data.split()
    lines = data.split(b"\n")
    n, size = len(words), max(len(data), 1)
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 7)
    _, upper, lower, digits, symbols, marks, breaks = kinds
    counts = Counter(words)
    doubled = sum(map(bytes.__eq__, words[1:], words))
    share = lambda part, whole: float(np.log(FLOOR + part / max(whole, 1)))
    return [
        float(np.log1p(n)),
        float(np.log1p(len(data) / max(n, 1))),
        share(upper, upper + lower),
        share(digits, size),
        share(symbols, size),
        share(marks, size),
        share(breaks, size),
        float(np.log1p(len(counts)) / np.log1p(max(n, 1))),
        share(max(counts.values(), default=0), n + 10),
        share(doubled, n),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log(len(zlib.compress(data, 1)) / (size + 50))),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every document."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "features": [statistics(t) for t in batch["text"]]})

    kept = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    out = kept.mapInPandas(tidied(measure), "doc_id string, features array<double>")
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "features")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Log prior minus log determinant, mean and inverse Cholesky factor per class; or a constant score."""

    offsets: np.ndarray | None
    means: np.ndarray | None
    factors: np.ndarray | None
    constant: float = 1.0

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(features), self.constant)
        logs = []
        for k in (0, 1):
            distance = (features - self.means[k]) @ self.factors[k].T
            logs.append(self.offsets[k] - 0.5 * np.einsum("ij,ij->i", distance, distance))
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / TEMPER, -700, 700)))


def class_sums(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Per class: rows, sums and sums of products of the features, added up by Spark."""
    d = len(FEATURES)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if not len(batch):
                continue
            x, y = np.stack(batch["features"].to_numpy()), batch["quality"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({"quality": np.repeat([0, 1], sums.shape[1]), "i": np.tile(np.arange(sums.shape[1]), 2), "s": sums.ravel()})

    parts = labelled.mapInPandas(tidied(add), "quality int, i int, s double")
    out = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in parts.groupBy("quality", "i").agg(F.sum("s").alias("s")).collect():
        out[r.quality][r.i] = r.s
    return out


def fit(labelled: DataFrame) -> Discriminant:
    """A discriminant from all rows of ``features, quality`` (0 or 1)."""
    d, sums = len(FEATURES), class_sums(labelled)
    n = np.array([sums[0][0], sums[1][0]])
    if n.min() == 0:
        return Discriminant(None, None, None, float(n[1] / n.sum()) if n.sum() else 1.0)
    means = np.stack([sums[k][1 : 1 + d] / n[k] for k in (0, 1)])
    scatter = [sums[k][1 + d :].reshape(d, d) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum() + 1e-6 * np.eye(d)
    offsets, factors = [], []
    for k in (0, 1):
        own = n[k] / (n[k] + d)  # few rows lean on the pooled covariance
        cov = own * scatter[k] / n[k] + (1 - own) * pooled
        cov = (1 - POOLED - DIAGONAL) * cov + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled))
        factor = np.linalg.cholesky(cov)
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
        factors.append(np.linalg.inv(factor))
    return Discriminant(np.array(offsets), means, np.stack(factors))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; learns from the folds that are not held out."""
    measured = settled(with_statistics(docs))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int"))
    model = fit(measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("features", "quality"))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for features in batches:
            yield pd.Series(model.score(np.stack(features.to_numpy())) if len(features) else [], dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.pandas_udf(score, "double")("features").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that the classifier does not reject, with all their columns.

    Each row is judged by its own text, so that rows sharing an id (or without
    one) need no join.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int"))
    measured = settled(with_statistics(docs))
    model = fit(measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("features", "quality"))

    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x) >= threshold, dtype="bool")

    keep.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(keep, "boolean")(F.coalesce("text", F.lit(""))))
