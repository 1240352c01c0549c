"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes.

Each indicator counts with the log of the ratio of its smoothed frequencies in the two classes. A hinge-loss linear
model on the scaled indicators is fitted by dual coordinate descent and blended with the mean weight. Learned from a
bounded sample of labelled rows, in one task; scoring is one map over all texts.

Defined results: a null or empty text has one feature of its own and a score; a very long text is read whole; without
labels every score is 0.5; an empty table gives no rows; repeated rows each keep a row; columns beside the id and the
text are not read, and may have any name.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import features as fx

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
SMOOTHING, COST, EPOCHS, BLEND = 1.0, 1.0, 8, 0.25


class Model(NamedTuple):
    """Weight of each indicator (its ratio times its hinge weight), bias, and the calibration of the margin."""

    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, indicators: np.ndarray) -> float:
        return float(self.weights[indicators].sum() / np.sqrt(len(indicators) or 1) + self.bias)

    def score(self, texts: list[str] | pa.Array) -> np.ndarray:
        return fx.sigmoid(self.a * np.array([self.margin(x) for x in fx.ngram_indicators(texts)]) + self.b)


def log_count_ratios(labels: np.ndarray, rows: list[np.ndarray], size: int) -> np.ndarray:
    counts = [SMOOTHING + np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k] or [np.zeros(0, np.int32)]), minlength=size) for k in (0, 1)]
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def dual_coordinate_descent(labels: np.ndarray, rows: list[np.ndarray], values: list[np.ndarray], size: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine: one dual variable at a time, between 0 and its class's
    cost, which weighs both classes alike."""
    y = np.where(labels == 1, 1.0, -1.0)
    cost = COST * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    norm = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def fit(labels: np.ndarray, rows: list[np.ndarray]) -> Model:
    size = 2 * fx.BINS
    ratio = log_count_ratios(labels, rows, size)
    values = [ratio[r] / np.sqrt(len(r) or 1) for r in rows]
    inner = np.arange(len(rows)) % 5 != 0  # the rest places the threshold
    if len(set(labels[inner])) < 2 or len(set(labels[~inner])) < 2:
        inner[:] = True
    at = np.flatnonzero(inner)
    w, bias = dual_coordinate_descent(labels[at], [rows[i] for i in at], [values[i] for i in at], size)
    used = np.unique(np.concatenate(rows))
    w[used] = (1 - BLEND) * np.abs(w[used]).mean() + BLEND * w[used]
    model = Model((ratio * w).astype(np.float32), bias, 1.0, 0.0)
    check = np.flatnonzero(~inner) if not inner.all() else at
    a, b = fx.calibration(np.array([model.margin(rows[i]) for i in check]), labels[check], THRESHOLD)
    return model._replace(a=a, b=b)


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labelled documents outside the held-out fold; the id is named alike in both tables."""
    sample = fx.labelled_sample(labels, label, FOLDS, HELD_OUT, id_col)
    found = fx.fitted(fx.sample_features(docs, sample, fx.ngram_indicators, id_col, text_col), fit)
    return found or Model(np.zeros(2 * fx.BINS, np.float32), 0.0, 1.0, 0.0)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    model = learned(docs, labels, id_col=id_col, text_col=text_col)
    return fx.scored(docs, model.score, FOLDS, HELD_OUT, THRESHOLD, id_col, text_col)


def keep_good(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model learned on ``training`` predicts to be good; columns as they were."""
    return fx.scored(docs, learned(training, labels).score, FOLDS, HELD_OUT, THRESHOLD, keep=docs.columns)
