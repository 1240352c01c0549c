"""The quality classifier against a plain version of its features, ratios, sample and scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from spreadloom.llm import features as fx
from spreadloom.llm import nb_svm
from tests.llm.test_models import labelled  # noqa: F401  the same documents


def plain_ngrams(text):
    words, out, forms = text.split(), set(), []
    for k, w in enumerate(words):
        found = fx.LETTERS.search(w.lower())
        if found:
            out.add(fx.hashed(found[0]))
        forms.append(fx.REPEATED if k and words[k - 1] == w else fx.hashed("\t" + fx.shape(w), fx.REPEATED))
    for n in (1, 2, 3):
        for k in range(len(forms) - n + 1):
            total = forms[k]
            if n > 1:
                total = 0
                for f in forms[k : k + n]:
                    total = (total * 1_000_003 + f + 17) % 2_147_483_647
            out.add(fx.BINS + total % fx.BINS)
    return sorted(out) or [fx.BINS]


TEXTS = ["", " \n ", "one", "The the the cat, sat on-the MAT 12!!", "a b a b a b", "é É 中文 x9X ***", "word " * 500, "don't “quote” ... ###", "A1 b2 C3 d4"]


@pytest.mark.parametrize("text", TEXTS)
def test_features(text):
    assert fx.ngram_indicators([text])[0].tolist() == plain_ngrams(text)


def test_log_count_ratios():
    rows, labels = [np.array(plain_ngrams(t), np.int32) for t in TEXTS], np.array([k % 2 for k in range(len(TEXTS))])
    counts = [Counter(i for r, y in zip(rows, labels) if y == c for i in r.tolist()) for c in (0, 1)]
    size = 2 * fx.BINS
    totals = [size + sum(c.values()) for c in counts]
    got = nb_svm.log_count_ratios(labels, rows, size)
    for i in {*counts[0], *counts[1], 5, size - 1}:
        assert got[i] == pytest.approx(math.log((1 + counts[1][i]) / totals[1]) - math.log((1 + counts[0][i]) / totals[0]))


@pytest.mark.parametrize(("id_col", "text_col"), [("doc_id", "text"), ("key", "body")])
def test_scores(labelled, id_col, text_col):  # noqa: F811
    docs, labels = labelled
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    sample = sorted(
        (np.array(plain_ngrams(r.text or ""), np.int32).tobytes(), truth[r.doc_id])
        for r in docs.collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 != 0
    )
    model = nb_svm.fit(np.array([y for _, y in sample]), [np.frombuffer(f, np.int32) for f, _ in sample])
    got = nb_svm.quality_scores(docs.withColumnsRenamed({"doc_id": id_col, "text": text_col}), labels.withColumnRenamed("doc_id", id_col), id_col, text_col).collect()
    assert len(got) == docs.count()
    for r in got:
        found = plain_ngrams(rows[r[id_col]])
        margin = sum(float(model.weights[i]) for i in found) / math.sqrt(len(found)) + model.bias
        want = 1 / (1 + math.exp(-min(30, max(-30, model.a * margin + model.b))))
        assert abs(r.score - want) < 1e-4 and (abs(want - 0.3) < 1e-4 or r.predicted == (want >= 0.3))
