"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1, all documents are unlabelled web text; labels of 0 are not used. A linear model over byte and word statistics minimises the non-negative unbiased risk

    prior * R_positive(+)  +  max(0, R_unlabelled(-) - prior * R_positive(-)),

and where the second part falls below zero, the step undoes the overfit instead. The prior, the share of positives in the web text, is estimated
from the same two samples (``class_prior``): above a score of a model that tells them apart, the share of unlabelled rows is at least the prior times
that of positives, so the least such ratio, where both shares are certain enough, is the estimate.

The fit uses at most ``POSITIVES`` and ``UNLABELLED`` ids (the smallest hashes), one row each (of rows that share an id the one with the least features);
only the features reach the driver. Scores cover all rows and whole texts.

Labels, language, source and id are never features. A null id is not held out and not sampled. Null and empty texts have features of their own
and a score. Without any positive label every score is 0.5. Repeated rows give repeated results, an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.common import by_slice, extend, table, words
from sessionloom.llm.quality import base_counts

POSITIVES, UNLABELLED = 4000, 8000
STEPS, BATCH, RATE, DECAY = 3000, 512, 0.01, 1e-4
SLACK = 0.0
DOUBT = 0.1  # chance that the bounds of the prior's estimate allow for

_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes are counted in 97 kinds: control characters, each printable ASCII character, all others.
_KIND = np.clip(np.arange(256) - 31, 0, 96).astype(np.int64)
FEATURES = 97 + 10


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of figures per text: byte kinds, word and line statistics."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), sizes)
    kinds = np.bincount(row_of * 97 + _KIND[data], minlength=rows * 97).reshape(rows, 97)
    starts, ends, first = words(data, offsets)
    n_words, chars, symbols, dup_lines, repeats = base_counts(data, offsets)
    word_row = np.repeat(np.arange(rows), n_words)
    lengths = ends - starts
    at_least = lambda x: np.maximum(x, 1)
    shouted = np.bincount(word_row, _UPPER[data[starts]] & _UPPER[data[ends - 1]] if len(starts) else None, rows)
    marked = np.bincount(word_row, ~_LETTER[data[ends - 1]] if len(starts) else None, rows)
    bare = np.bincount(word_row, (lengths == 1) & ~_LETTER[data[starts]] if len(starts) else None, rows)
    long = np.bincount(word_row, lengths > 20, rows)
    lines = np.bincount(row_of, data == 10, rows) + 1
    extra = [
        np.log1p(n_words), chars / at_least(n_words), symbols / at_least(n_words), dup_lines / lines, repeats / at_least(n_words),
        shouted / at_least(n_words), marked / at_least(n_words), bare / at_least(n_words), long / at_least(n_words),
        np.log1p(n_words / lines),
    ]
    return np.column_stack([np.sqrt(kinds / at_least(sizes)[:, None]), *extra]).astype(np.float32)


class Linear:
    """Weights for standardised, clipped features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -5, 5), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Linear:
    """Minimise the non-negative risk of the logistic loss by stochastic steps of Adam."""
    rng = np.random.default_rng(11)
    model = Linear(unlabelled.mean(0), unlabelled.std(0) + 1e-3, np.zeros(unlabelled.shape[1] + 1))
    p, u = model.inputs(positive), model.inputs(unlabelled)
    w, m, v = model.weights, 0.0, 0.0
    slope = lambda x: 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))  # noqa: E731  of log(1 + exp(f)), the loss of calling a row positive
    for step in range(1, STEPS + 1):
        a, b = p[rng.integers(len(p), size=BATCH)], u[rng.integers(len(u), size=BATCH)]
        sa, sb = slope(a), slope(b)
        as_negative = lambda x: np.logaddexp(0, x @ w).mean()
        rest = as_negative(b) - prior * as_negative(a)
        down = (sb[:, None] * b).mean(0) - prior * (sa[:, None] * a).mean(0)
        gradient = prior * ((sa - 1)[:, None] * a).mean(0) + down if rest >= -SLACK else -down
        gradient = gradient + DECAY * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, kept off the ends; 0.5 where a sample has less than two rows.

    Each half of the samples is scored by a model of the other half. Of all scores the one counts whose ratio of shares above it has the least upper
    bound: further up few rows are left, and the ratio is noise.
    """
    found = []
    for k in (0, 1):
        (p, q), (u, v) = (positive[k::2], positive[1 - k :: 2]), (unlabelled[k::2], unlabelled[1 - k :: 2])
        if not (len(p) and len(q) and len(u) and len(v)):
            return 0.5
        model = fit(p, u, 0.5)
        known, web = np.sort(model.score(q)), np.sort(model.score(v))
        at = np.unique(known)
        of_known, of_web = 1 - np.searchsorted(known, at) / len(known), 1 - np.searchsorted(web, at) / len(web)
        bound = of_web + sum(np.sqrt(np.log(4 / DOUBT) / (2 * n)) for n in (len(known), len(web)))
        best = np.argmin(bound / of_known)
        found.append(of_web[best] / of_known[best])
    return float(np.clip(np.mean(found), 0.05, 0.95))


def feature_rows(docs: DataFrame) -> DataFrame:
    """Replace ``text`` by its features."""
    at = docs.columns.index("text")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = np.concatenate([features(data, offsets) for _, _, data, offsets in by_slice(batch.column(at))])
        return [pa.array(list(rows), pa.list_(pa.float32()))]

    return extend(docs, [T.StructField("text", T.ArrayType(T.FloatType()))], make)


def sampled(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """``(doc_id, trusted, text)``, ``text`` being features: one row for each id of the two samples, however many rows have it."""
    ids = lambda df, n: df.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    wanted = ids(labels.where("quality = 1"), positives).withColumn("trusted", F.lit(True)).unionByName(ids(docs, unlabelled).withColumn("trusted", F.lit(False)))
    met = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "trusted", "text")  # broadcast: two bounded samples
    return feature_rows(met).groupBy("doc_id", "trusted").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear | None:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, quality)`` that hold no row to be judged."""
    if labels.where("quality = 1").isEmpty():
        return None
    found = sampled(docs, labels, positives, unlabelled).toArrow()
    trusted = found["trusted"].to_numpy()
    x = np.array(found["text"].to_pylist(), np.float32).reshape(len(trusted), FEATURES)
    x = x[order := np.lexsort([*x.T[:3], trusted])]
    trusted = trusted[order]
    if not trusted.any() or trusted.all():
        return None
    return fit(x[trusted], x[~trusted], class_prior(x[trusted], x[~trusted]))


def predict(docs: DataFrame, model: Linear | None, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        scores = [model.score(features(data, offsets)) if model else np.full(j - i, 0.5) for i, j, data, offsets in by_slice(batch.column(at))]
        scores = np.concatenate(scores)
        return [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]

    return extend(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text, learned from the label rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = learn(docs.where(~held), labels.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
