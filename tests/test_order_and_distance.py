"""Sliding order statistics, distance correlation and time warping against plain versions."""

import time

import numpy as np
import pandas as pd
import pytest

from spreadloom.operators import order_statistics as o
from spreadloom.operators import sequential as s
from spreadloom.operators import warping
from spreadloom.operators import windows as w


def plain(x, n, i):
    frame = x[max(0, i - n + 1) : i + 1]
    return np.sort(frame[~np.isnan(frame)])


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_sliding_window(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=300), 1)
    x[rng.integers(0, 300, 40)] = np.nan
    x[100:110] = np.nan
    got = o.along(x, n, 0, [0.25, 0.9])
    for i, row in enumerate(got):
        f = plain(x, n, i)
        assert row[0] == len(f)
        if len(f):
            m = np.median(f)
            assert np.allclose(row[3:], [m, np.median(abs(f - m)), *np.quantile(f, [0.25, 0.9])], atol=1e-12)
        if x[i] == x[i]:
            assert (row[1], row[2]) == ((f < x[i]).sum(), (f == x[i]).sum())


def test_blocks_give_what_whole_series_give(spark):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"symbol": ["a"] * 900 + ["b"] * 33, "dt": [*range(900), *range(33)], "v": np.round(rng.normal(size=933), 2), "tag": "t"})
    f.loc[[3, 4, 500], "v"] = np.nan
    df = spark.createDataFrame(f.sample(frac=1, random_state=3)).replace(float("nan"), None)
    got = {(r.symbol, r.dt): r for r in o.rolling_order(df, "v", 12, {"q": 0.75}, block=100).collect()}
    assert len(got) == 933
    for key, g in f.groupby("symbol"):
        x = g["v"].to_numpy()
        for i in range(len(x)):
            r, frame = got[key, i], plain(x, 12, i)
            assert r.n_frame == len(frame) and abs(r.median - np.median(frame)) < 1e-12 and abs(r.q - np.quantile(frame, 0.75)) < 1e-12 and r.tag == "t"
            assert (r.below is None) == np.isnan(x[i])
    scores = w.robust_scores(df, "v", 12).where("symbol = 'a'").toPandas().sort_values("dt").reset_index(drop=True)
    frame = plain(f[f.symbol == "a"]["v"].to_numpy(), 12, 899)
    v, m = f.v[899], np.median(frame)
    assert abs(scores.mad_score[899] - (v - m) / (1.4826 * np.median(abs(frame - m)))) < 1e-9 and np.isnan(scores.mad_score[3]) and np.isnan(scores.mad_score[8])


def test_a_row_costs_the_same_in_a_wide_window():
    x = np.random.default_rng(2).normal(size=30_000)
    seconds = []
    for n in (50, 5000):
        began = time.process_time()
        o.along(x, n, 0, [0.9])
        seconds.append(time.process_time() - began)
    assert seconds[1] < 4 * seconds[0]


def plain_dcor(x, y):
    a, b = (abs(v[:, None] - v[None, :]) for v in (x, y))
    a, b = (d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (a, b))
    return np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))


def test_distance_correlation(spark):
    rng = np.random.default_rng(5)
    legs = {f"n{n}": (x := rng.normal(size=n), x**2 + 0.2 * rng.normal(size=n)) for n in (2, 3, 17, 128, 301)}
    legs["ties"] = (np.repeat([1.0, 2.0, 3.0], 30), np.tile([5.0, 5.0, 7.0], 30) + np.repeat([0, 0, 1.0], 30))
    legs["far"] = (1e6 + rng.normal(size=90), 1e6 + rng.normal(size=90))
    legs["flat"] = (np.ones(20), rng.normal(size=20))
    f = pd.concat([pd.DataFrame({"pair_id": k, "dt": range(len(x)), "x": x, "y": y}) for k, (x, y) in legs.items()])
    got = {r.pair_id: r.dcor for r in s.distance_correlation(spark.createDataFrame(f)).collect()}
    assert got.pop("flat") is None and len(got) == 7
    for k, v in got.items():
        assert abs(v - plain_dcor(*legs[k])) < 1e-6, k


def test_distance_correlation_of_a_long_pair():
    rng = np.random.default_rng(6)
    x = rng.normal(size=100_000)
    began = time.process_time()
    d = s.distance_covariance(x, x + rng.normal(size=len(x)))
    assert 0 < d < 1 and time.process_time() - began < 30
    part = x[:1500]
    a = abs(part[:, None] - part[None, :])
    c = a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    assert abs(s.distance_covariance(part, part) - (c * c).mean()) < 1e-9


def plain_dtw(a, b, band):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(max(1, i - band), min(len(b), i + band) + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1]


def test_warping():
    rng = np.random.default_rng(7)
    for n, m, band in ((1, 1, 0), (5, 5, 0), (6, 6, 1), (30, 30, 4), (31, 28, 5), (12, 20, 3), (40, 40, 100)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        assert s.warped(a, b, band) == pytest.approx(plain_dtw(a, b, band))


def test_nearest_by_warping_is_exact_and_leaves_pairs_out(spark):
    rng = np.random.default_rng(8)
    t = np.arange(80)
    series = {f"s{i:02d}": np.sin(2 * np.pi * t / (9 + 7 * (i % 5)) + rng.uniform(0, 1)) + 0.1 * rng.normal(size=80) for i in range(15)}
    series["flat"] = np.ones(80)
    names = sorted(series)
    rows = [(f"{a}/{b}", a, b, k, float(series[a][k]), float(series[b][k])) for a in names for b in names if a < b for k in range(80)]
    pairs = spark.createDataFrame(rows, "pair_id string, sym_x string, sym_y string, dt int, x double, y double")
    z = {k: (v - v.mean()) / (v.std() or 1.0) for k, v in series.items()}
    want = {a: min((plain_dtw(*sorted_legs(z, a, b), 4), b) for b in names if b != a) for a in names}
    got = warping.nearest_by_warping(pairs, 4).collect()
    assert len(got) == 16
    for r in got:
        assert r.nearest == want[r.symbol][1] and abs(r.dtw - want[r.symbol][0]) < 1e-9 and r.n_pairs == 15
    assert sum(r.n_warped for r in got) < 0.7 * sum(r.n_pairs for r in got)


def sorted_legs(z, a, b):
    return (z[a], z[b]) if a < b else (z[b], z[a])
