"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Voters look for words of a lexicon, for patterns, and for words and stems that the labelled sample shows to go with
toxic texts. The label model is a latent class with, for each voter, its rates of voting in toxic and other texts.
Gold labels of the sample give the mined voters, the rate of toxic texts and the first guess of the rates; expectation
maximization over the vote patterns of all documents then estimates the rates, and voters' weights fall with their
correlations to others within the classes. A logistic model on hashed words and stems is trained on the posterior
labels of the sample, and calibrated on a fifth of the sample that is kept apart from its training. Vote patterns are
counted before anything is gathered; each step of the estimation is an aggregate.

Defined results: a null or empty text has no votes and a score; a very long text is read whole, and a stem counts in it
where ``features.ENOUGH`` words have it; without labels only the lexicon and patterns vote, and a sample of documents,
bounded as that of labels, is learned from; an empty table gives no rows; repeated rows each keep a row; columns beside the id and the text are not read, and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as fx
from .common import dropped, prepare, slices, stored, text_or_empty

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
ANCHORS = (("you are ", "you all "), ("shut up", "go to hell", "get lost", "drop dead", "kill your"), ("hate ", "despise ", "will hurt "))
MINED, EM_STEPS, EPOCHS, CHOSEN = 40, 8, 12, 8192
#: Toxic texts that the part kept apart for calibration needs.
LEAST_APART = 20

#: Words of abuse, a voter a line.
LEXICON = (
    "idiot moron stupid dumb fool imbecile",
    "loser pathetic worthless useless failure",
    "scum trash garbage filth vermin",
    "clown disgusting ugly creep freak",
    "idiote imbécile stupide connard ordure salaud minable",
    "dummkopf trottel abschaum widerlich erbärmlich versager",
    "estúpido imbécil basura asqueroso inútil patético",
)
#: Patterns of address and of threat, a voter each, and strings of which each match holds one.
PATTERNS = (
    r"you (?:are|all) (?:so |such )?(?:an? )?(?:idiot|moron|loser|stupid|pathetic|worthless|disgusting)",
    r"(?:shut up|go to hell|get lost|drop dead|kill your ?self)\b",
    r"(?:hate|despise|will hurt) (?:you|them)\b",
)


def base_voters() -> list[np.ndarray]:
    """Hashed words of each line of the lexicon."""
    return [np.array(sorted({fx.hashed(w) for w in line.split()}), np.int32) for line in LEXICON]


def mine(labels: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Hashed words and stems that go with toxic texts: by the difference of their rates over its deviation, without
    those that are nearly always found together with a better one.
    """
    size = 2 * fx.BINS
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    df = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k] or [np.zeros(0, np.int32)]), minlength=size) for k in (0, 1)]
    both = df[0] + df[1]
    z = (df[1] / n[1] - df[0] / n[0]) / np.sqrt((both + 1) / sum(n) * (1 / n[0] + 1 / n[1]))
    good = np.flatnonzero((df[1] >= 4) & (df[1] >= 2 * df[0]) & (z > 4))
    good = good[np.argsort(-z[good], kind="stable")][: 20 * MINED]
    place = np.full(size, -1)
    place[good] = np.arange(len(good))
    found = np.zeros((len(good), len(rows)), bool)
    for i, r in enumerate(rows):
        at = place[r]
        found[at[at >= 0], i] = True
    chosen: list[int] = []
    for k in range(len(good)):
        if len(chosen) < MINED and all((found[k] & found[c]).sum() < 0.6 * min(found[k].sum(), found[c].sum()) for c in chosen):
            chosen.append(k)
    return np.sort(good[chosen]).astype(np.int32)


def pattern_bits(text: str) -> int:
    """Bits of the patterns that a text holds, at their places among the votes."""
    lower = text.lower()
    return sum(1 << k for k, (pattern, anchors) in enumerate(zip(PATTERNS, ANCHORS), len(LEXICON)) if any(a in lower for a in anchors) and re.search(pattern, lower))


class Voters:
    """The lexicon's lines, the patterns and the mined features, each a bit of the votes; a last one if all are silent."""

    def __init__(self, mined: np.ndarray):
        self.mined = mined
        self.bits: dict[int, int] = {}
        for k, line in enumerate(base_voters()):
            for word in line.tolist():
                self.bits[word] = self.bits.get(word, 0) | 1 << k
        for k, feature in enumerate(mined.tolist(), len(LEXICON) + len(PATTERNS)):
            self.bits[feature] = self.bits.get(feature, 0) | 1 << k
        self.known = np.zeros(2 * fx.BINS, bool)
        self.known[[*self.bits]] = True

    def __len__(self) -> int:
        return len(LEXICON) + len(PATTERNS) + len(self.mined) + 1

    def votes(self, indicators: np.ndarray, patterns: int) -> int:
        """Bits of the voters that vote toxic, from the known features and the pattern bits of a text."""
        out = patterns
        for feature in indicators.tolist():
            out |= self.bits.get(feature, 0)
        return out or 1 << len(self) - 1


class LabelModel(NamedTuple):
    """Rate of toxic texts; for each voter its rates of voting in other and toxic texts, and its weight."""

    prior: float
    rates: np.ndarray  # (2, voters)
    weight: np.ndarray
    seen: np.ndarray  # labelled texts of either class behind the first guess

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of votes (n, voters). A voter that doesn't vote abstains."""
        odds = votes @ (self.weight * np.log(self.rates[1] / self.rates[0]))
        return fx.sigmoid(odds + np.log(self.prior / (1 - self.prior)))


def started(labels: np.ndarray, votes: np.ndarray) -> LabelModel:
    """The first guess, from the labelled sample."""
    n = votes.shape[1]
    rates = np.vstack([(votes[labels == k].sum(0) + 0.5) / ((labels == k).sum() + 5) for k in (0, 1)])
    return LabelModel(float(np.clip((labels == 1).mean(), 0.01, 0.5)), np.clip(rates, 1e-4, 0.999), np.ones(n), np.bincount(labels, minlength=2)[:2].astype(float))


def guessed(n: int) -> LabelModel:
    """The first guess where there are no labels."""
    rates = np.vstack([np.full(n, 0.01), np.full(n, 0.2)])
    rates[:, -1] = 0.95, 0.2
    return LabelModel(0.1, rates, np.ones(n), np.array([90.0, 10.0]))


def unpacked(votes: np.ndarray, n: int) -> np.ndarray:
    return (votes[:, None] >> np.arange(n) & 1).astype(bool)


def estimated(patterns: DataFrame, model: LabelModel, steps: int = EM_STEPS) -> LabelModel:
    """Expectation maximization over (votes, count), one aggregate a step. The first guess counts as the texts behind
    it; the rate of toxic texts stays as it is there.
    """
    n, first_guess = len(model.weight), model
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], model: LabelModel = model) -> Iterator[pa.RecordBatch]:
            mass, first, second = np.zeros(2), np.zeros((2, n)), np.zeros((2, n, n))
            for batch in batches:
                votes, count = unpacked(batch.column(0).to_numpy(), n), batch.column(1).to_numpy().astype(float)
                p = model.posterior(votes)
                for k, part in enumerate((count * (1 - p), count * p)):
                    mass[k] += part.sum()
                    first[k] += part @ votes
                    second[k] += (votes * part[:, None]).T @ votes
            yield pa.RecordBatch.from_arrays([pa.array(range(len(all_ := np.concatenate([mass, first.ravel(), second.ravel()])))), pa.array(all_)], ["at", "value"])

        total = {r["at"]: r["value"] for r in patterns.mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
        if not total:
            return model
        flat = np.array([total[k] for k in range(len(total))])
        mass, first, second = flat[:2], flat[2 : 2 + 2 * n].reshape(2, n), flat[2 + 2 * n :].reshape(2, n, n)
        own = model.seen[:, None]
        rates = np.clip((first + own * first_guess.rates) / (mass[:, None] + own), 1e-5, 0.999)
        rates[1, :-1] = np.maximum(rates[1, :-1], rates[0, :-1])  # a vote speaks for toxic, silence against it
        rates[1, -1] = min(rates[1, -1], rates[0, -1])
        share = second / np.maximum(mass, 1e-9)[:, None, None]
        spread = np.sqrt(rates * (1 - rates))
        correlation = np.abs((share - rates[:, :, None] * rates[:, None, :]) / (spread[:, :, None] * spread[:, None, :]))
        correlation = np.clip((correlation * mass[:, None, None] / max(mass.sum(), 1e-9)).sum(0), 0, 1)
        np.fill_diagonal(correlation, 1.0)
        correlation[-1, :-1] = correlation[:-1, -1] = 0  # silence excludes votes by its meaning
        model = model._replace(rates=rates, weight=1 / np.where(correlation > 0.1, correlation, 0).sum(1))
    return model


class Classifier(NamedTuple):
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, indicators: np.ndarray) -> float:
        return float(self.weights[indicators].sum() + self.bias)

    def score(self, texts: list[str] | pa.Array) -> np.ndarray:
        """Only features with a weight are taken."""
        return fx.sigmoid(self.a * np.array([self.margin(x) for x in fx.stem_indicators(texts, self.weights != 0)]) + self.b)


def trained(target: np.ndarray, rows: list[np.ndarray], seed: int = 11) -> tuple[np.ndarray, float]:
    """A logistic model by adaptive gradients on soft labels, over the features that best part them."""
    size = 2 * fx.BINS
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    df, toxic = np.bincount(flat, minlength=size), np.bincount(flat, target[of], minlength=size)
    mean = target.mean()
    z = np.abs(toxic - df * mean) / np.sqrt(df * mean * (1 - mean) + 1)
    use = np.zeros(size, bool)
    use[np.argsort(-z, kind="stable")[:CHOSEN]] = True
    use &= (df >= 3) & (z > 3)
    own = [r[use[r]] for r in rows]
    w, bias, seen, seen_bias = np.zeros(size), float(np.log((mean + 1e-6) / (1 - mean + 1e-6))), np.full(size, 1.0), 1.0
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(own)):
            gap = 1 / (1 + np.exp(-np.clip(w[own[i]].sum() + bias, -30, 30))) - target[i]
            if abs(gap) > 1e-4:
                seen[own[i]] += gap * gap
                seen_bias += gap * gap
                w[own[i]] -= 0.5 * gap / np.sqrt(seen[own[i]])
                bias -= 0.1 * gap / np.sqrt(seen_bias)
    return w.astype(np.float32), bias


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    spark = docs.sparkSession
    prepare(spark)
    sample = stored(fx.sample_features(docs, fx.labelled_sample(labels, "toxic", FOLDS, HELD_OUT), fx.stem_indicators, id_col, text_col, pattern_bits), "sample")
    mined = fx.fitted(sample, lambda labels, rows, bits: mine(labels, rows))
    voters = Voters(np.zeros(0, np.int32) if mined is None else mined)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                texts = part.column(0)
                votes = [voters.votes(x, pattern_bits(t)) for x, t in zip(fx.stem_indicators(texts, voters.known), texts.to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(votes, pa.int64())], ["votes"])

    patterns = stored(docs.select(text_or_empty(text_col).alias("text")).mapInArrow(vote, "votes long").groupBy("votes").count(), "votes")
    of_sample = lambda rows, bits: unpacked(np.array([voters.votes(r, b) for r, b in zip(rows, bits.tolist())]), len(voters))
    first = fx.fitted(sample, lambda labels, rows, bits: started(labels, of_sample(rows, bits)))
    model = estimated(patterns, first or guessed(len(voters)))

    def fit(labels: np.ndarray, rows: list[np.ndarray], bits: np.ndarray) -> Classifier:
        target = model.posterior(of_sample(rows, bits))
        truth = labels if first else (target >= THRESHOLD).astype(int)
        inner = np.arange(len(rows)) % 5 != 0
        if (truth[~inner] == 1).sum() < LEAST_APART:
            inner[:] = True  # too few to place a threshold by: all rows train and calibrate
        at, check = np.flatnonzero(inner), np.flatnonzero(inner if inner.all() else ~inner)
        w, bias = trained(target[at], [rows[k] for k in at])
        out = Classifier(w, bias, 1.0, 0.0)
        a, b = fx.calibration(np.array([out.margin(rows[k]) for k in check]), truth[check], THRESHOLD)
        return out._replace(a=a, b=b)

    if not first:
        dropped(sample)
        sample = stored(unlabelled(docs, id_col, text_col), "sample")
    out = fx.fitted(sample, fit) or Classifier(np.zeros(2 * fx.BINS, np.float32), 0.0, 1.0, -1.0)
    for gone in (sample, patterns):
        dropped(gone)
    return out


def unlabelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sample where there are no labels: of the at most ``features.SAMPLE`` ids with the smallest hashes outside the
    held-out fold, one row each; its label (0) says nothing."""
    ids = docs.select(id_col).where(F.col(id_col).isNotNull() & (fx.crc32_of_id(id_col) % FOLDS != HELD_OUT)).distinct()
    chosen = ids.orderBy(F.xxhash64(id_col), id_col).limit(fx.SAMPLE)
    one = docs.join(F.broadcast(chosen), id_col, "left_semi").groupBy(id_col).agg(F.min(text_or_empty(text_col)).alias(text_col))
    return fx.sample_features(one, chosen.select(id_col, F.lit(0).alias("label")), fx.stem_indicators, id_col, text_col, pattern_bits)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return fx.scored(docs, learned(docs, labels, id_col, text_col).score, FOLDS, HELD_OUT, THRESHOLD, id_col, text_col)
