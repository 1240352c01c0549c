"""Sequential statistics on seeded series: ranges and orderings, and closed forms where there are some."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import pairs as p
from spreadloom.operators import scoring, sequential
from spreadloom.operators import windows as w


def walk_pair(kind: str, seed: int, n: int = 600) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    y = np.cumsum(0.015 * rng.normal(size=n)) + 4
    ou = np.zeros(n)
    for k in range(1, n):
        ou[k] = 0.85 * ou[k - 1] + 0.008 * rng.normal()
    x = {"cointegrated": 0.9 * y + ou, "unrelated": np.cumsum(0.01 * rng.normal(size=n)) + 4, "trending": y + np.cumsum(0.01 * rng.normal(size=n))}[kind]
    return pd.DataFrame({"sym_x": kind, "sym_y": "Y", "pair_id": kind, "dt": pd.date_range("2020-01-01", periods=n).date, "x": np.exp(x), "y": np.exp(y)})


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(pd.concat([walk_pair("cointegrated", 42), walk_pair("unrelated", 99), walk_pair("trending", 7)]))


def test_tests_tell_the_pairs_apart(pairs):
    t = {r.pair_id: r for r in sequential.pair_tests(pairs).collect()}
    assert t["cointegrated"].adf_p < 0.01 < 0.1 < min(t["unrelated"].adf_p, t["trending"].adf_p) + 0.1
    assert t["cointegrated"].eg_p < 0.05 and t["cointegrated"].johansen_ok
    assert sequential.hurst_rs(np.random.default_rng(0).normal(size=600)) < 0.8 < t["trending"].hurst
    assert t["trending"].kpss > t["cointegrated"].kpss


def test_verdict(pairs):
    v = {r.pair_id: r.verdict for r in scoring.validated(p.pair_metrics(pairs), sequential.pair_tests(pairs), p.hedge_stability(pairs), corr=0.3, low=1.0).collect()}
    assert v["cointegrated"] in ("PASS", "WARN") and v["unrelated"] == "FAIL"


def test_adf_without_lags_equals_the_closed_form(spark, pairs):
    s = p.spread(pairs, p.static_hedge(pairs))
    native = {r.pair_id: r.adf_t for r in p.dickey_fuller(s).collect()}
    for key, rows in s.toPandas().groupby("pair_id"):
        assert sequential.adf(rows.sort_values("dt")["spread"].to_numpy(), 0)[0] == pytest.approx(native[key], rel=1e-6)


def test_hedge_ratio_and_half_life(pairs):
    h = {r.pair_id: r for r in p.static_hedge(pairs).collect()}["cointegrated"]
    one = walk_pair("cointegrated", 42)
    b = np.polyfit(np.log(one.y), np.log(one.x), 1)
    assert (h.beta, h.intercept) == pytest.approx(tuple(b), rel=1e-6)
    hl = {r.pair_id: r.half_life for r in p.half_life(p.spread(pairs, p.static_hedge(pairs))).collect()}
    assert 2 < hl["cointegrated"] < 10 < hl["trending"]


def test_kalman_follows_the_ratio(pairs):
    last = sequential.kalman_hedge(pairs.where("pair_id = 'cointegrated'")).orderBy(F.col("dt").desc()).first()
    assert abs(last.error) < 0.1 and 0.5 < last.beta < 1.5


def test_p_values_at_known_points():
    assert sequential.unit_root_p(-2.86) == pytest.approx(0.05, abs=2e-3) and sequential.unit_root_p(-3.43) == pytest.approx(0.01, abs=1e-3)
    assert sequential.unit_root_p(-3.34, 2) == pytest.approx(0.05, abs=3e-3)
    assert sequential.chi_square_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4) and sequential.chi_square_tail(7.815, 3) == pytest.approx(0.05, abs=1e-4)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, d, float(v)) for d, v in zip(pd.date_range("2020-01-01", periods=len(values)).date, values)], "symbol string, dt date, close double")


def test_constant_and_short_series_give_nulls(spark):
    flat = w.rolling_zscore(series(spark, [5] * 30), "close", 20).collect()
    assert all(r.z is None for r in flat)
    assert all(r.corr is None for r in w.rolling_pair(series(spark, [5] * 30).withColumn("y", F.col("close") + 1), "close", "y", 20, "symbol").collect())
    assert w.rolling_moments(series(spark, [1, 2, 3]), "close", 5).where("mean IS NOT NULL").count() == 0


def test_ewma_and_moments_equal_pandas(spark):
    v = np.random.default_rng(1).normal(size=80).cumsum()
    s = pd.Series(v)
    got = w.ewma(series(spark, v), "close", 10).orderBy("dt").toPandas()
    np.testing.assert_allclose(got.ewma, s.ewm(span=10, adjust=False).mean())
    m = w.rolling_moments(series(spark, v), "close", 20).orderBy("dt").toPandas()
    np.testing.assert_allclose(m["skew"], s.rolling(20).skew(), atol=1e-8)
    np.testing.assert_allclose(m["kurt"], s.rolling(20).kurt(), atol=1e-8)


def test_cycle_and_entropy(spark):
    t = np.arange(256)
    r = sequential.spectrum(series(spark, np.sin(2 * math.pi * t / 16)), "close").first()
    assert r.period == pytest.approx(16) and r.share > 0.95
    noise = sequential.sample_entropy(series(spark, np.random.default_rng(0).normal(size=200)), "close").first().sampen
    assert noise > sequential.sample_entropy(series(spark, np.sin(t[:200] / 5)), "close").first().sampen


def test_features_do_not_look_ahead(spark):
    from spreadloom.operators import features as k

    v = np.random.default_rng(3).normal(size=90).cumsum() + 100
    bars = series(spark, v).withColumn("volume", F.lit(1.0))
    names = list(k.REGISTRY)
    whole = {r.dt: r for r in k.computed(bars, names).collect()}
    for r in k.computed(bars.where("dt <= '2020-03-10'"), names).collect():
        assert r == whole[r.dt]
