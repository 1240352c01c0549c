"""A corpus from raw documents to packed sequences: quality rules, quality classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm import hamming_join, nb_svm, packing, quality_rules
from spreadloom.llm.common import dropped, stored, table, text_or_empty


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the rule table."""
    return quality_rules.keep_good(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be good, by a model learned on the labelled documents of the whole table."""
    return nb_svm.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the smallest id. Different texts that share an id
    are documents of their own; of rows that repeat an id and its text one stays; documents without id stay."""
    text = text_or_empty()
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        found = stored(hamming_join.near_duplicates(docs, width=5, percent=80), "groups")
        return docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    first = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("_first"))
    own = F.lit(1 << 62) + F.xxhash64("doc_id", text).bitwiseAND(F.lit((1 << 62) - 1))  # after the ids
    key = F.when(F.col("_first").isNull() | (F.xxhash64(text) == F.col("_first")), F.col("doc_id")).otherwise(own)
    keyed = stored(docs.join(first, "doc_id", "left").select(*docs.columns, key.alias("_key"), F.col("_first").isNotNull().alias("_many")), "keyed")
    found = stored(hamming_join.near_duplicates(keyed, width=5, percent=80, id_col="_key"), "groups")
    out = keyed.join(found.where(~F.col("kept")).select("_key").distinct(), "_key", "left_anti")
    return out.where("NOT _many").unionByName(out.where("_many").dropDuplicates(["_key"])).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("near_duplicates", without_near_duplicates),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing; tests hold run() against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        dropped(before)
    return docs
