"""The Pareto front of whole tables against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import tables as t


@pytest.fixture(scope="module")
def points():
    x = np.random.default_rng(4).normal(size=(3000, 3)).round(2)
    x[:1500] /= np.linalg.norm(x[:1500], axis=1, keepdims=True)  # a large front
    return np.unique(np.concatenate([x, x[:5]]), axis=0)


def test_fronts_in_blocks_equal_brute_force(spark, points):
    want = {tuple(p) for p in points if not ((points >= p).all(1) & (points > p).any(1)).any()}
    df = spark.createDataFrame(points.tolist(), "a double, b double, c double").repartition(7)
    for block in (20, 150, 8192):
        assert {tuple(r) for r in t.front_of(df, block).collect()} == want


def test_the_front_is_of_all_rows_without_a_broadcast(spark):
    """A row with the lowest score, beyond any top-k, but the best drawdown; ties, nulls and NaN."""
    rows = [(k, 1000.0 + k, 1.0, 0.5) for k in range(400)] + [(900, 0.0, 0.0, 0.1), (901, 0.0, 0.0, 0.1), (902, None, float("nan"), 0.1), (903, None, None, None), (904, float("nan"), 2.0, None)]
    df = spark.createDataFrame(rows, "id long, score double, sharpe double, drawdown double").repartition(5)
    front = t.pareto_front(df, ["score", "sharpe"], ["drawdown"], "id")
    assert sorted(r.id for r in front.collect()) == [399, 900, 901, 904]
    assert "NestedLoop" not in front._jdf.queryExecution().toString()
    assert t.pareto_front(df.where(F.lit(False)), ["score", "sharpe"], ["drawdown"], "id").count() == 0
