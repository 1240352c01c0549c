"""Registered queries that SQL doesn't express, recomputed with numpy from the panels that they read."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import features as k
from spreadloom.operators import windows as w
from spreadloom.plans import market
from spreadloom.plans.job_queries import spread_z
from spreadloom.plans.pair_queries import pairs_of
from spreadloom.plans.table_queries import FOLD_TABLE
from spreadloom.sources import panels
from spreadloom.streaming.jobs import walk

SMALL = "/root/testdata/sf0.001"
MACRO = ["discount", "tax", "returned", "quantity"]


def run(spark, name):
    return market.queries()[name](spark, SMALL)


@pytest.fixture(scope="module")
def pairs(spark):
    f = pairs_of(spark, SMALL).select("pair_id", "sym_x", "sym_y", "dt", "x", "y").toPandas().sort_values(["pair_id", "dt"])
    return {name: (g.x.to_numpy(), g.y.to_numpy()) for name, g in f.groupby("pair_id")}


@pytest.fixture(scope="module")
def macro(spark):
    return panels.macro(spark, SMALL).toPandas().sort_values("dt").reset_index(drop=True)


def test_granger(spark, pairs):
    def f_of(a, b, lags=2):
        rows = range(lags, len(b))
        own = np.array([[1, *(b[i - j] for j in (1, 2))] for i in rows])
        both = np.array([[1, *(b[i - j] for j in (1, 2)), *(a[i - j] for j in (1, 2))] for i in rows])
        sse = [((b[lags:] - x @ np.linalg.lstsq(x, b[lags:], rcond=None)[0]) ** 2).sum() for x in (own, both)]
        return (sse[0] - sse[1]) / lags / (sse[1] / (len(both) - 5))

    rows = run(spark, "i16_granger").collect()
    assert len(rows) == len(pairs)
    for r in rows:
        x, y = (np.diff(np.log(v)) for v in pairs[r.pair_id])
        if r.f_x_to_y is not None:
            assert r.f_x_to_y == pytest.approx(f_of(x, y), rel=1e-6) and r.f_y_to_x == pytest.approx(f_of(y, x), rel=1e-6)


def test_time_warping(spark, pairs):
    rows = {r.pair_id: r.dtw for r in run(spark, "i19_time_warping").collect()}
    assert rows.keys() == pairs.keys()
    for name in sorted(pairs)[::60]:
        a, b = ((v - v.mean()) / (v.std() or 1.0) for v in pairs[name])
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(max(1, i - 10), min(len(b), i + 10) + 1):
                d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        assert rows[name] == pytest.approx(d[-1, -1])


def test_principal_components(spark, macro):
    v = macro[MACRO].to_numpy()
    z = (v - v.mean(0)) / v.std(0, ddof=1)
    _, _, t = np.linalg.svd(z, full_matrices=False)
    got = run(spark, "i23_principal_components").toPandas().sort_values("dt")
    scores = np.array(got.scores.tolist())
    for c in range(2):
        want = z @ t[c]
        assert np.allclose(scores[:, c], want, atol=1e-6) or np.allclose(scores[:, c], -want, atol=1e-6)


def test_mahalanobis_of_the_macro_book(spark, macro):
    v = macro[MACRO].to_numpy()
    got = run(spark, "i26_mahalanobis").toPandas().sort_values("dt").distance.to_numpy()
    for i in range(len(v)):
        if i < 52:
            assert np.isnan(got[i])
        else:
            e = v[i] - v[i - 52 : i].mean(0)
            assert got[i] == pytest.approx(math.sqrt(e @ np.linalg.inv(np.cov(v[i - 52 : i], rowvar=False)) @ e), rel=1e-5)


def test_spectrum_and_sample_entropy(spark):
    bars = panels.bars(spark, SMALL).toPandas().sort_values(["symbol", "dt"])
    spectra = {r.symbol: r for r in run(spark, "i18_spectrum").collect()}
    entropy = {r.symbol: r.sampen for r in run(spark, "i20_sample_entropy").collect()}
    for symbol, g in [*bars.groupby("symbol")][::6]:
        x = g.close.to_numpy()
        t = np.arange(len(x))
        p = abs(np.fft.rfft(x - np.polyval(np.polyfit(t, x, 1), t)))[1:] ** 2
        p = p / p.sum()
        assert spectra[symbol].period == pytest.approx(len(x) / (p.argmax() + 1)) and spectra[symbol].share == pytest.approx(p.max(), rel=1e-6)
        n, r, m = len(x), 0.2 * x.std(), 2
        near = lambda length: sum(max(abs(x[i : i + length] - x[j : j + length])) <= r for i in range(n - m) for j in range(i + 1, n - m))  # noqa: B023, E731
        a, b = near(m + 1), near(m)
        assert entropy[symbol] is None if not (a and b) else entropy[symbol] == pytest.approx(-math.log(a / b))


def test_selected_features_are_those_without_a_correlated_one_before(spark):
    names = ["z", "z_abs", "z_mean", "z_std", "z_mom", "z_ar1"]
    z = k.z_features(spread_z(spark, SMALL)).dropna().select("pair_id", "dt", *names).toPandas()
    c = z[names].corr().to_numpy()
    kept = []
    for i in range(len(names)):
        if all(abs(c[i, j]) <= 0.8 for j in kept):
            kept.append(i)
    got = run(spark, "k11_feature_selection")
    assert got.columns == ["pair_id", "dt", *(names[i] for i in kept)] and got.count() == len(z)


def test_clusters_cover_every_symbol_once(spark):
    got = run(spark, "i22_return_clusters").toPandas()
    symbols = {r.symbol for r in panels.bars(spark, SMALL, "month").select("symbol").distinct().collect()}
    assert sorted(got.symbol) == sorted(symbols) and got.cluster.between(0, 3).all() and got.cluster.nunique() > 1


def test_block_bootstrap_brackets_the_mean(spark):
    r = w.returns(panels.bars(spark, SMALL)).where("ret IS NOT NULL").select("symbol", "dt", "ret").toPandas()
    got = {x.symbol: x for x in run(spark, "k20_block_bootstrap").collect()}
    assert got.keys() == set(r.symbol)
    rng = np.random.default_rng(0)
    for symbol, g in r.sort_values("dt").groupby("symbol"):
        v, x = g.ret.to_numpy(), got[symbol]
        assert x.observed == pytest.approx(v.mean()) and x.is_positive == (x.low > 0)
        blocks = [v[i : i + 10] for i in range(0, len(v), 10)]
        means = [np.concatenate([blocks[j] for j in rng.integers(0, len(blocks), len(blocks))]).mean() for _ in range(2000)]
        low, high = np.quantile(means, [0.05, 0.95])
        width = high - low
        assert abs(x.low - low) < 0.35 * width and abs(x.high - high) < 0.35 * width


def test_calibration_is_isotonic_and_its_errors_are_right(spark):
    from spreadloom.operators import pipelines as pl

    got = run(spark, "k14_calibration").toPandas()
    ordered = got.sort_values(["p", "calibrated"])
    assert (np.diff(ordered.calibrated) >= -1e-12).all() and got.calibrated.between(0, 1).all()
    e = pl.calibration_errors(spark.createDataFrame(got), "calibrated", "y").first()
    known = got.dropna(subset=["y"])
    bins = np.minimum(np.floor(known.calibrated * 10), 9)
    gaps = known.groupby(bins).apply(lambda g: abs(g.calibrated.mean() - g.y.mean()))
    sizes = known.groupby(bins).size()
    assert e.brier == pytest.approx(((known.calibrated - known.y) ** 2).mean()) and e.mce == pytest.approx(gaps.max()) and e.ece == pytest.approx((gaps * sizes).sum() / len(known))
    quality = run(spark, "k14_calibration_quality").toPandas()
    iso = quality[quality.method == "isotonic"].iloc[0]
    assert iso.brier == pytest.approx(e.brier) and set(quality.method) == {"none", "isotonic", "sigmoid"}


def test_models_score_the_rows_after_training(spark):
    got = run(spark, "k12_model_scores").toPandas()
    assert got.probability.between(0, 1).all() and str(got.dt.min()) > "1999-12-31"
    want = np.where(got.probability >= 0.6, "take", np.where(got.probability <= 0.4, "skip", "neutral"))
    assert (got.action == want).all()
    assert got.probability.nunique() > 10
    gains = run(spark, "k18_importance").toPandas()
    assert set(gains.feature) == {"z_abs", "z_mean", "z_std", "z_ar1"} and gains.gain.sum() == pytest.approx(1) and (gains.gain >= 0).all()


def test_walk_forward_counts_the_episodes_of_the_test_parts(spark):
    got = run(spark, "j19_walk_forward").toPandas()
    pair, fold = got.pair_id[0], int(got.fold[0])
    own = spark.sql(FOLD_TABLE).where(F.col("fold") == fold).first()
    a, b, c, e = [pd.Timestamp(own[x]) for x in ("train_start", "train_end", "test_start", "test_end")]
    f = pairs_of(spark, SMALL).where(F.col("pair_id") == pair).toPandas().sort_values("dt")
    f["dt"] = pd.to_datetime(f.dt)
    train, test = f[(f.dt >= a) & (f.dt <= b)], f[(f.dt >= c) & (f.dt <= e)]
    beta, alpha = np.polyfit(np.log(train.y), np.log(train.x), 1)
    s = np.log(train.x) - alpha - beta * np.log(train.y)
    z = (np.log(test.x) - alpha - beta * np.log(test.y) - s.mean()) / s.std(ddof=1)
    events, _ = walk(pd.DataFrame({"ts": test.dt, "z": z}), 0, 0, 0.0, 1.5, 0.5, 6.0, 30)
    done = [x for x in events if x[1] != "OPEN"]
    row = got[(got.pair_id == pair) & (got.fold == fold)].iloc[0]
    assert row.n_trades == len(done) and row.pnl_z == pytest.approx(sum(x[3] for x in done), abs=1e-6)


def test_the_verdict_follows_its_tests(spark):
    ratios = {r.pair_id: r.vr for r in run(spark, "i07_variance_ratio").collect()}
    rows = run(spark, "i10_validation_verdict").collect()
    assert {r.pair_id for r in rows} == ratios.keys()
    for r in rows:
        of = {t.name: t for t in r.tests}
        vr = ratios[r.pair_id]
        assert not of["variance_ratio"].is_hard and of["variance_ratio"].passed == (vr is None or vr < 1)
        assert vr is None or abs(of["variance_ratio"].value - vr) < 1e-5
        hard, soft = (any(not t.passed for t in r.tests if t.is_hard == h) for h in (True, False))
        assert r.verdict == ("FAIL" if hard else "WARN" if soft else "PASS")
