"""Discovery of candidates: every pair of a family is tested, and the ranks of the decisions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import pairs as p
from spreadloom.operators import pipelines as pl
from spreadloom.operators import sequential as s
from spreadloom.plans import market
from spreadloom.sources import panels

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    return panels.bars(spark, SMALL, "month").localCheckpoint()


def test_all_pairs_of_the_families_are_tested(spark, bars):
    every = p.all_pairs(bars, "vwap")
    strong = {r.pair_id for r in p.pair_correlation(every, 0.05, least=30).where("is_candidate").collect()} | {r.pair_id for r in p.price_distance(every).where("score >= 0.2").collect()}
    want = {r.pair_id for r in s.pair_tests(every).where("eg_p <= 0.2").collect()} & strong
    assert len(strong) > 100 and len(want) > 100
    got = pl.candidates(bars, "vwap", 0.05)
    assert {r.pair_id for r in got.collect()} == want
    best = sorted(got.collect(), key=lambda r: (-r.quality, r.pair_id))[:7]
    assert [r.pair_id for r in pl.candidates(bars, "vwap", 0.05, 7).orderBy(F.col("quality").desc(), "pair_id").collect()] == [r.pair_id for r in best]
    assert want <= {r.pair_id for r in market.queries()["j03_candidates"](spark, SMALL).collect()}


def test_pairs_within_a_cluster_are_a_family(spark):
    """One pair of a cluster whose correlation is below the bound of the first family and whose prices part."""
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=200) * 0.2)
    y = 4 * x + rng.normal(size=200) * 1.0
    y[0] -= 5
    rows = [("A", k, float(np.exp(v))) for k, v in enumerate(x)] + [("B", k, float(np.exp(v))) for k, v in enumerate(y)]
    bars = spark.createDataFrame(rows, "symbol string, k int, vwap double").select("symbol", F.date_add(F.lit("2020-01-01").cast("date"), "k").alias("dt"), "vwap")
    c = p.pair_correlation(p.all_pairs(bars, "vwap"), 0.0, max_vol_ratio=1e9).first().corr
    groups = spark.createDataFrame([("A", 0), ("B", 0)], "symbol string, cluster int")
    low = abs(c) / 0.9
    assert p.price_distance(p.all_pairs(bars, "vwap")).first().score < 0.2 and pl.candidates(bars, "vwap", low).count() == 0
    assert [(r.pair_id, r.family) for r in pl.candidates(bars, "vwap", low, groups=groups).collect()] == [("A/B", "cluster")]
    assert pl.candidates(bars, "vwap", low, groups=groups.withColumn("cluster", (F.col("symbol") == "A").cast("int"))).count() == 0


def test_ranks(spark):
    rows = [(str(k), float(v)) for k, v in enumerate(np.random.default_rng(2).random(500).round(2))] + [("x", None), ("y", 1.0), ("z", 0.0)]
    got = pl.ranked(spark.createDataFrame(rows, "pair_id string, score double"), F.col("score"), "pair_id", 10).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 504))
    assert [r.pair_id for r in got] == [k for k, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
