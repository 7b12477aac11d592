"""A quality classifier from positives and unlabelled text.

Trusted positives and a draw of unlabelled documents are all it learns from; labels of
other values are not used.  The share of positives among the unlabelled is estimated
first: a plain classifier tells the two apart, and in the region it holds most positive
the unlabelled rows are about all positive, so the least ratio of the two tails, over the
thresholds with enough rows, estimates the share.  Then the non-negative unbiased risk

    p * mean(loss(+), positives) + max(0, mean(loss(-), unlabelled) - p * mean(loss(-), positives))

is minimised over linear scores of simple text features with the logistic loss, so the
score estimates a probability.  Both draws are bounded (``MAX_POSITIVES``,
``MAX_UNLABELLED``, those of the smallest hash of the id); every document is scored, whole.

Defined results: NULL and empty texts have the features of a text without words and get
its score; without positives or unlabelled rows there is nothing to learn and every score
is 1; a NULL id is never learnt from and not held out; equal rows get equal scores; empty
tables give no rows.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import named

MAX_POSITIVES = 20_000
MAX_UNLABELLED = 40_000
THRESHOLD = 0.3
FOLDS = 5
STEPS = 600
RATE = 0.1
RIDGE = 5.0  # shared by the positives: the fewer there are, the plainer the model
TAIL = 200
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"


def features(text: str | None) -> list[float]:
    """Rates of a text: length, variety, repetition, case, marks, digits, repeated lines."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 12
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    symbols = sum(map(text.count, SYMBOLS))
    return [
        math.log1p(n),
        distinct / n,
        math.log1p(distinct) / math.log1p(n),
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        min(3.0, text.count("!") / n),
        min(3.0, symbols / n),
        math.log1p(symbols / n),
        sum(map(text.count, DIGITS)) / n,
        min(2.0, (text.count(".") + text.count(",")) / n),
        sum(map(len, words)) / n / 10,
        1 - len(set(lines)) / len(lines),
    ]


@dataclass(frozen=True)
class Model:
    """A linear score of standardised features, clipped; what every task needs to score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.abs(z), np.ones((len(z), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        # Row by row, so that a text's score does not depend on its batch.
        return _sigmoid((self.scaled(x) * self.weights).sum(axis=1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _minimise(gradient, size: int) -> np.ndarray:
    """Adam, a fixed number of steps over all rows."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scaled features of both."""

    ridge = RIDGE / len(positive)

    def gradient(w: np.ndarray) -> np.ndarray:
        up = -positive.T @ (1 - _sigmoid(positive @ w)) / len(positive)
        down = unlabelled.T @ _sigmoid(unlabelled @ w) / len(unlabelled)
        return up + down + ridge * w

    w = _minimise(gradient, positive.shape[1])
    p, u = np.sort(positive @ w), np.sort(unlabelled @ w)
    cuts = np.quantile(p, np.linspace(0, 1, 201)[:-1])
    tail_p = len(p) - np.searchsorted(p, cuts)
    tail_u = len(u) - np.searchsorted(u, cuts)
    enough = tail_p >= min(TAIL, len(p) // 4)
    # The upper end of the ratio, so that a thin tail does not win by chance.
    slack = np.sqrt(1 / tail_p + 1 / np.maximum(1, tail_u))
    ratio = tail_u / len(u) / (tail_p / len(p))
    best = np.argmin(np.where(enough, ratio * (1 + slack), np.inf))
    return float(np.clip(ratio[best], 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Minimise the non-negative unbiased risk over rows of features."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    blank = Model(mean, scale, np.zeros(2 * len(mean) + 1), 1.0)
    p, u = blank.scaled(positive), blank.scaled(unlabelled)
    prior = estimate_prior(p, u) if prior is None else prior
    ridge = RIDGE / len(p)

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        risk = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
        negative = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        if risk < 0:  # overfitted negatives: step back on them alone
            return -negative + ridge * w
        return -prior * p.T @ (1 - sp) / len(p) + negative + ridge * w

    return Model(mean, scale, _minimise(gradient, p.shape[1]), prior)


def fold(id_col: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, by ``folds``: 0 is held out."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model | None:
    """Learn from positives of ``labels`` and any documents, held-out ids left out.

    The ids drawn are broadcast and the features of one row of each come to the driver; both
    are bounded by the two limits.  Of rows that repeat an id it is the one of the least hash
    of the text.
    """
    train_ids = fold(named(id_col)) != 0

    def draw(rows: DataFrame, most: int) -> DataFrame:
        ids = rows.where(train_ids).select(named(id_col).alias("_id")).distinct()
        return ids.orderBy(F.xxhash64("_id"), "_id").limit(most)

    positives = draw(labels.where(named(label_col) == 1), max_positives)
    drawn = (
        draw(docs, max_unlabelled)
        .withColumn("_u", F.lit(True))
        .join(positives.withColumn("_p", F.lit(True)), "_id", "full")
    )
    texts = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    found = texts.join(F.broadcast(drawn), "_id").select(
        F.xxhash64("_id").alias("at"),
        F.xxhash64("_text").alias("hash"),
        F.coalesce("_p", F.lit(False)).alias("p"),
        F.coalesce("_u", F.lit(False)).alias("u"),
        named("_text").alias("text"),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(x, pa.list_(pa.float64()))],
                ["at", "hash", "p", "u", "x"],
            )

    kind = "at long, hash long, p boolean, u boolean, x array<double>"
    first = F.min(F.struct("hash", "x"))["x"].alias("x")
    rows = found.mapInArrow(measure, kind).groupBy("at", "p", "u").agg(first).toArrow()
    rows = rows.sort_by("at")
    if not len(rows):
        return None
    x = np.array(rows.column("x").to_pylist(), float)
    p, u = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in "pu")
    if not p.any() or not u.any():
        return None
    return fit(x[p], x[u])


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with ``score_col`` (0 to 1) added, or put in its place."""
    if model is None:
        return docs.withColumn(score_col, F.lit(1.0))
    rows = docs.select(*[named(c) for c in docs.columns if c != score_col])
    at = rows.columns.index(text_col)
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()], float)
            s = model.scores(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"]
            )

    scored = plain.mapInArrow(run, plain.withColumn("score", F.lit(1.0)).schema)
    return scored.toDF(*rows.columns, score_col)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    **options,
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 at ``threshold`` or above)."""
    model = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    return score(rows, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(
    docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    mark = "score"
    while mark.lower() in {c.lower() for c in docs.columns}:
        mark += "_"
    return score(docs, model, text_col, mark).where(F.col(mark) >= threshold).drop(mark)
