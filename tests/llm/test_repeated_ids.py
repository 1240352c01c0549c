"""Different documents that share an id are kept apart in the pipeline."""

import random

import corpus_pipeline


def test_only_copies_are_dropped(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (2, a + " x"), (2, b), (3, c), (3, d), (3, d), (4, e), (None, e)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_duplicates(spark, docs, "")
    want = [(1, a), (2, b), (3, c), (3, d), (4, e), (None, e)]
    assert got.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
