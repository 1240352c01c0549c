"""The pipeline against a version by brute force on a small corpus, stage by stage and as a whole."""

import random

import duckdb
import pytest
from test_documents import components
from test_tokens import check_packing

import corpus_pipeline
from spreadloom.llm import nb_svm, quality_rules


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choices("aeiou", k=1) + rng.choices("bcdfg", k=2) + rng.choices("aeiou", k=2)) for _ in range(400)] + ["the", "of", "and", "to"] * 20
    docs, labels = [], []
    for k in range(300):
        text = rng.choices(words, k=rng.randint(30, 200))
        good = k % 4 != 0
        if not good:
            text = [w + ("***" if k % 8 else ".") for w in text]
            if k % 8 == 0:
                text = [w.upper() for w in text]
        docs.append((k, " ".join(text), "en", "s", 1))
        labels.append((k, int(good), 0))
    near = docs[1][1].split()
    docs += [(400 + k, " ".join(near[:k] + ["zz"] + near[k + 1 :]), "en", "s", 1) for k in range(5)] + [(410, docs[2][1], "en", "s", 1), (410, docs[2][1], "en", "s", 1), (3, docs[3][1], "en", "s", 1)]
    docs += [(500, None, None, None, None), (501, "", "", "", 0), (None, docs[5][1] + " x", None, None, None), (502, " ".join(rng.choices(words, k=9000)), "en", "s", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def key(r):
    return str(r.doc_id), str(r.text)


def test_stages_and_run(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_duplicates", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules, classifier, dedup, packing = (f for _, f in corpus_pipeline.STAGES)

    by_rules = rules(spark, docs, sf_dir)
    assert by_rules.columns == docs.columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT row_number() OVER () AS doc_id, text FROM read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    assert by_rules.count() == con.execute(quality_rules.duckdb_sql()).fetchdf().kept.sum()
    con.close()

    good = classifier(spark, by_rules, sf_dir)
    model = nb_svm.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = by_rules.collect()
    want = [r for r, s in zip(rows, model.score([r.text or "" for r in rows])) if s >= 0.3]
    assert sorted(map(key, good.collect())) == sorted(map(key, want)) and good.columns == docs.columns

    kept = dedup(spark, good, sf_dir)
    label = components([(r.doc_id, r.text) for r in want if r.doc_id is not None], 5, 80)
    ids = sorted({r.doc_id for r in want if r.doc_id is not None and label[r.doc_id][1] == r.doc_id})
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == ids and sum(r.doc_id is None for r in got) == sum(r.doc_id is None for r in want)
    assert not {401, 410} & set(ids)

    n = check_packing(packing(spark, kept, sf_dir).collect(), got, 4096)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert check_packing(whole, got, 4096) == n


def test_nothing_in_nothing_out(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
