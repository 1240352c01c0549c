"""Votes of patterns reach the classifier, and features of very long words and texts."""

import random
import zlib

import numpy as np
import pytest

from spreadloom.llm import features as fx
from spreadloom.llm import weak_supervision as ws


@pytest.fixture(scope="module")
def phrases(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("aeiou", k=1) + rng.choices("bcdfg", k=2) + rng.choices("aeiou", k=1)) for _ in range(300)]
    docs = [(k, " ".join(rng.choices(words, k=30) + (["drop", "dead"] if k % 10 == 0 else []))) for k in range(400)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def held(k: int) -> bool:
    return zlib.crc32(str(k).encode()) % ws.FOLDS == ws.HELD_OUT


def test_without_labels_patterns_are_learned(spark, phrases):
    rows = ws.toxicity_scores(phrases, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert all(r.predicted == (r.doc_id % 10 == 0) for r in rows) and any(r.held_out for r in rows)


def test_with_labels_the_sample_has_the_votes_of_patterns(spark, phrases):
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(400)], "doc_id long, toxic int")
    sample = fx.sample_features(phrases, fx.labelled_sample(labels, "toxic", ws.FOLDS, ws.HELD_OUT), fx.stem_indicators, bits=ws.pattern_bits).collect()
    assert sum(not held(k) for k in range(400)) == len(sample) and all((r.bits == 1 << len(ws.LEXICON) + 1) == (r.label == 1) and (r.bits > 0) == (r.label == 1) for r in sample)
    voters = ws.Voters(np.zeros(0, np.int32))
    votes = ws.unpacked(np.array([voters.votes(np.frombuffer(r.features, np.int32), r.bits) for r in sample]), len(voters))
    first = ws.started(np.array([r.label for r in sample]), votes)
    assert first.rates[1, len(ws.LEXICON) + 1] > 0.8 > 0.01 > first.rates[0, len(ws.LEXICON) + 1]
    assert ((first.posterior(votes) > 0.5) == [r.label == 1 for r in sample]).all()


def test_the_shape_is_of_the_whole_word():
    assert fx.shape("a" * 70 + "9" * 70 + "B/") == "x9X/"


def test_what_follows_a_passage_takes_no_stem_of_it_away():
    clean = [f"q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(6000)]
    stem = fx.word_and_stems(["zorkab"])[0, 1 + fx.STEMS.index(4)]
    for toxic, rest, kept in ((["zorkab", "zorked", "zorkum"] * 6, 6000, True), (["zorkab", "zorked"] * 3, 6000, True), (["zorkab", "zorked"], 400, True), (["zorkab", "zorked"], 6000, False)):
        alone, followed = (fx.stem_indicators([" ".join(t)])[0] for t in (toxic, toxic + clean[:rest]))
        assert stem in alone and (stem in followed) == kept
        assert len(toxic) < 18 or {*alone} <= {*followed}  # every stem of the first passage is of six words or more
