"""Hashed text features and what the two classifiers share: the labelled sample, tasks over it, calibration."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, prepare, slices, text_or_empty

#: At most so many labelled rows are learned from: those with the smallest hashes of their ids. They are few enough to
#: be broadcast and to be fitted in one task.
SAMPLE = 20_000
#: Number of hashed features of each kind.
BINS = 1 << 18
#: Lengths of the stems of a word.
STEMS = (3, 4, 5, 6, 7)
#: Words that a stem needs in a text of any length, and words of a text a word for which two or more are enough.
ENOUGH, DENSE = 6, 250
REPEATED = 0xFFFF
#: From the first letter of a word to its last.
LETTERS = re.compile(r"[^\W\d_](?:.*[^\W\d_])?", re.DOTALL)


def shape(word: str) -> str:
    """Runs of upper case, lower case and digits as X, x and 9; all else as it is, without repeats."""
    if word.isalpha():
        if word.islower():
            return "x"
        if word[1:].islower() and word[0].isupper():
            return "Xx"
    out = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def hashed(text: str, bins: int = BINS) -> int:
    return xxhash.xxh3_64_intdigest(text) % bins


def letters(words: list[str]) -> list[str]:
    """Each word in lower case, from its first letter to its last."""
    lower = [w.lower() for w in words]
    return [w if w.isalpha() else m[0] if (m := LETTERS.search(w)) else "" for w in lower]


def hashes(strings: list[str]) -> np.ndarray:
    """Of each string its hashed feature, of an empty one -1."""
    found = (np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings)) % np.uint64(BINS)).astype(np.int32)
    return np.where([*map(bool, strings)], found, -1).astype(np.int32)


def word_and_stems(words: list[str]) -> np.ndarray:
    """A row for each word: the hashed feature of its letters, and those of its stems (-1: none)."""
    own = letters(words)
    signs = np.array(own, f"U{STEMS[-1] + 1}").view(np.uint32).reshape(len(own), STEMS[-1] + 1)
    out = np.full((len(own), 1 + len(STEMS)), -1, np.int32)
    out[:, 0] = hashes(own)
    total = np.zeros(len(own), np.uint64)
    for k in range(STEMS[-1]):
        total = (total + signs[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        if k + 1 in STEMS:
            out[:, 1 + STEMS.index(k + 1)] = np.where(signs[:, k + 1] > 0, BINS + ((total ^ total >> np.uint64(32)) % np.uint64(BINS)).astype(np.int64), -1)
    return out


def word_and_shape(words: list[str]) -> np.ndarray:
    """A row for each word: the hashed feature of its letters (-1: none), and the hash of its shape."""
    return np.stack([hashes(letters(words)), np.array([hashed("\t" + shape(w), REPEATED) for w in words], np.int32)], 1)


def coded(texts: list[str] | pa.Array, make: Callable[[list[str]], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, their rows of ``make``) of each text; different words of the texts are made once."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    words = split.flatten().dictionary_encode()
    table, at, ends = make(words.dictionary.to_pylist()), words.indices.to_numpy(), split.offsets.to_numpy()
    nothing = words.dictionary.index("").as_py()  # what the split gives of an empty text and of white space at an end
    for start, end in zip(ends, ends[1:]):
        own = at[start:end]
        own = own[own != nothing]
        yield own, table[own]


def ngram_indicators(texts: list[str] | pa.Array) -> list[np.ndarray]:
    """Of each text its distinct hashed n-grams: single words, and one to three shapes in a row, a repeated word being a
    shape too."""
    return [ngrams(at, rows) if len(at) else np.array([BINS], np.int32) for at, rows in coded(texts, word_and_shape)]


def ngrams(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    form = rows[:, 1].astype(np.int64)
    form[1:][at[1:] == at[:-1]] = REPEATED
    parts = [rows[:, 0][rows[:, 0] >= 0], BINS + form % BINS]
    for n in (2, 3):
        total = np.zeros(max(0, len(form) - n + 1), np.int64)
        for k in range(n):
            total = (total * 1_000_003 + form[k : len(form) - n + 1 + k] + 17) % 2_147_483_647
        parts.append(BINS + total % BINS)
    return np.unique(np.concatenate(parts)).astype(np.int32)


def stem_indicators(texts: list[str] | pa.Array, known: np.ndarray | None = None) -> list[np.ndarray]:
    """Of each text its distinct hashed words, and stems that enough words begin with: ``ENOUGH`` in any text, two in a text
    of up to ``DENSE`` words a word. So what follows a passage never takes away a stem that it holds ``ENOUGH`` times; fewer
    are chance in a long text. If ``known`` is given, only the features it marks, whose counts alone are then taken."""
    out = []
    for at, rows in coded(texts, word_and_stems):
        use = rows >= 0
        if known is not None:
            use &= known[rows]
        stems, n = np.unique(rows[:, 1:][use[:, 1:]], return_counts=True)
        stems = stems[(n >= ENOUGH) | (n >= 2) & (DENSE * n >= len(at))]
        out.append(np.concatenate([np.unique(rows[:, 0][use[:, 0]]), stems]))
    return out


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(id, label) of at most ``sample`` labelled rows outside the held-out fold."""
    own = labels.select(id_col, F.col(label).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (crc32_of_id(id_col) % folds != held_out))
    return own.orderBy(F.xxhash64(id_col), id_col).limit(sample)


def sample_features(docs: DataFrame, sample: DataFrame, indicators: Callable[[pa.Array], list[np.ndarray]], id_col: str = "doc_id", text_col: str = "text", bits: Callable[[str], int] | None = None) -> DataFrame:
    """(label, features), and what ``bits`` gives of the text if it is given, of the sampled documents."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1)
                columns = [part.column(0), pa.array([x.tobytes() for x in indicators(texts)], pa.binary()), *([pa.array(map(bits, texts.to_pylist()), pa.int64())] if bits else [])]
                yield pa.RecordBatch.from_arrays(columns, ["label", "features", "bits"][: len(columns)])

    rows = docs.select(id_col, text_or_empty(text_col).alias("text")).join(F.broadcast(sample), id_col).select("label", "text")
    return rows.mapInArrow(work, "label int, features binary" + ", bits long" * bool(bits))


def fitted(rows: DataFrame, fit: Callable[..., object]) -> object:
    """Fits a model in one task on the bounded sample (labels, features, and bits if it has them); None where it is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, features, bits = [], [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            features += batch.column(1).to_pylist()
            bits += batch.column(2).to_pylist() if batch.num_columns > 2 else []
        if labels:
            order = sorted(range(len(labels)), key=lambda k: (features[k], labels[k], *bits[k : k + 1]))  # whatever order the rows came in
            model = fit(np.array([labels[k] for k in order]), [np.frombuffer(features[k], np.int32) for k in order], *([np.array([bits[k] for k in order])] if bits else []))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibration(margins: np.ndarray, labels: np.ndarray, at: float) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) rises with the margin and is ``at`` where the two classes part best."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], labels[order]
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    good = np.concatenate([[0.0], np.cumsum(np.where(y == 0, 1 / n0, -1 / n1))])  # cut before the k-th margin
    best = np.flatnonzero(good >= good.max() - 1e-12)
    k = int(best[len(best) // 2])
    cut = m[0] - 1 if k == 0 else m[-1] + 1 if k == len(m) else (m[k - 1] + m[k]) / 2
    spread = float(np.percentile(np.abs(m - cut), 75)) or 1.0
    a = 3.0 / spread
    return a, float(np.log(at / (1 - at)) - a * cut)


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], folds: int, held_out: int, at: float, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, held_out, score, predicted) of every document, or the columns ``keep`` where predicted is 1."""
    prepare(docs.sparkSession)
    fold = F.coalesce(crc32_of_id(id_col), F.lit(0)) % folds == held_out
    base = docs.select(F.struct(*(keep or [id_col])).alias("own"), fold.alias("fold"), text_or_empty(text_col).alias("whole_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                value = score(part.column(2))
                own = part.column(0).flatten()
                if keep:
                    yield pa.RecordBatch.from_arrays(own, keep).filter(pa.array(value >= at))
                else:
                    yield pa.RecordBatch.from_arrays([own[0], part.column(1), pa.array(value, pa.float64()), pa.array((value >= at).astype(np.int32), pa.int32())], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return base.mapInArrow(work, docs.select(*keep).schema if keep else f"{id_col} {kind}, held_out boolean, score double, predicted int")
