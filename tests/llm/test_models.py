"""Both classifiers by held-out accuracy, and the nearest neighbours by recall."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.llm import nb_svm, nn_descent, weak_supervision
from spreadloom.llm import features as fx


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("aeiou", k=1) + rng.choices("bcdfg", k=2) + rng.choices("aeiou", k=1)) for _ in range(300)]
    docs, labels = [], []
    for k in range(600):
        text = rng.choices(words, k=rng.randint(20, 80))
        good, toxic = k % 3 != 0, k % 4 == 0
        if not good:
            text = [w + rng.choice(["***", "###"]) for w in text]
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron", "zorkab", "zorked", "zorkum"]))
        docs.append((k, " ".join(text), "z", "z"))
        labels.append((k, int(good), int(toxic)))
    docs += [(1000, None, None, None), (1001, "", "", ""), (1002, words[0] * 5000, "z", "z"), (None, "abc", "z", "z"), (5, docs[5][1], "z", "z")]
    labels += [(2000, 1, 0), (None, 1, 1), (1, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, label string, features string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "column", "folds", "held"), [(nb_svm.quality_scores, 1, 5, 0), (weak_supervision.toxicity_scores, 2, 4, 2)])
def test_classifier(labelled, score, column, folds, held):
    docs, labels = labelled
    rows = score(docs, labels).collect()
    truth = {r[0]: r[column] for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows if r.doc_id is not None)
    test = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.95
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.limit(0)).count() == docs.count()
    again = {(r.doc_id, r.score) for r in score(docs.repartition(7), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}


def test_held_out_labels_have_no_influence(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda l: {(r.doc_id, r.score) for r in nb_svm.quality_scores(docs, l).collect()}
    assert scores(labels) == scores(flipped)


def test_dual_coordinate_descent_meets_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(int)
    rows = [np.arange(5, dtype=np.int32)] * 60
    w, b = nb_svm.dual_coordinate_descent(y, rows, list(x), 5, epochs=400)
    s = np.where(y == 1, 1, -1)
    cost = nb_svm.COST * np.where(s > 0, 60 / (2 * (s > 0).sum()), 60 / (2 * (s < 0).sum()))
    value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - s * (x @ v[:5] + v[5]))).sum()
    best = np.append(w, b)
    assert all(value(best) <= value(best + d) + 1e-3 for d in rng.normal(scale=0.05, size=(200, 6)))


def test_label_model_finds_the_better_voter(spark):
    rng = np.random.default_rng(1)
    toxic = rng.random(4000) < 0.2
    hits = ((0.8, 0.01), (0.7, 0.02), (0.6, 0.01), (0.3, 0.2))  # the last says next to nothing
    votes = np.stack([np.where(toxic, rng.random(4000) < p, rng.random(4000) < q) for p, q in hits], 1)
    bits = (votes * [1, 2, 4, 8]).sum(1)
    bits[bits == 0] = 16
    patterns = spark.createDataFrame([(int(b), int((bits == b).sum())) for b in np.unique(bits)], "votes long, count long")
    model = weak_supervision.estimated(patterns, weak_supervision.guessed(5), 20)
    ratio = model.rates[1] / model.rates[0]
    assert min(ratio[:3]) > 5 * ratio[3] and ratio[4] < 1
    all_votes = weak_supervision.unpacked(bits, 5)
    assert ((model.posterior(all_votes) > 0.5) == toxic)[votes.any(1)].mean() > 0.8


def test_calibration_keeps_order():
    a, b = fx.calibration(np.array([-2.0, -1, 1, 2]), np.array([0, 0, 1, 1]), 0.3)
    assert a > 0 and fx.sigmoid(np.array([a * -1 + b]))[0] < 0.3 < fx.sigmoid(np.array([a * 1 + b]))[0]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(12, 16))[rng.integers(0, 12, 900)] + 0.5 * rng.normal(size=(900, 16))).astype(np.float32)
    v[100:160] = v[100]  # equal vectors: ties go to the smaller id
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (950, [float("nan")] * 16, 0), (903, [None] * 16, 0), (None, v[0].tolist(), 0), (50, v[50].tolist(), 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node int").repartition(3)
    got = {}
    for r in nn_descent.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d = v.astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    assert set(got) == set(range(0, 900, 50))
    hits = 0
    for q, found in got.items():
        found.sort()
        cos = d @ d[q]
        assert [x[0] for x in found] == [1, 2, 3, 4, 5] and all(abs(s - cos[i]) < 1e-12 for _, i, s in found)
        cos[q] = -2
        best = np.lexsort((np.arange(900), -np.round(cos, 12)))[:5]
        hits += len({i for _, i, _ in found} & set(best.tolist()))
    assert hits >= 0.9 * 5 * len(got)
    assert [x[1] for x in got[150]] == [100, 101, 102, 103, 104] and [x[1] for x in got[100]] == [101, 102, 103, 104, 105]
    assert nn_descent.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = table.where("vec_id in (0, 1, 2)")
    assert sorted((r["rank"]) for r in nn_descent.search(few, F.col("vec_id") % 50 == 0).collect()) == [1, 2]


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(k, [float(k % 7 + 1), float(k % 5), 1.0]) for k in range(60)] + [(100, [1.0] * 6), (150, [1.0] * 2)]
    got = nn_descent.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in got} == {0, 50} and not {r.vec_id for r in got} & {100, 150} and len(got) == 10


@pytest.mark.parametrize("keep_good", [lambda docs, labels: nb_svm.keep_good(docs, docs, labels)])
def test_columns_of_any_name_are_kept(spark, labelled, keep_good):
    docs, labels = labelled
    clashing = docs.withColumnsRenamed({"label": "text_", "features": "held_out_"}).withColumn("fold", F.lit(1)).withColumn("whole_text", F.lit("z"))
    kept = keep_good(clashing, labels)
    assert kept.columns == clashing.columns and kept.where("text_ = 'z' AND fold = 1").count() > 100
