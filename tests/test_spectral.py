"""Spectra against numpy."""

import numpy as np
import pandas as pd
import pytest

from spreadloom.operators import spectral as sp


@pytest.fixture(scope="module")
def legs():
    rng = np.random.default_rng(4)
    out = {}
    for name, n in (("a", 200), ("b", 131), ("short", 20), ("one", 40)):
        x = rng.normal(size=n) + 3
        out[name] = (x, np.roll(x, 2) + 0.3 * rng.normal(size=n))
    out["flat"] = (np.ones(100), rng.normal(size=100))
    return out


def frame(spark, legs):
    rows = pd.concat([pd.DataFrame({"pair_id": k, "dt": pd.date_range("2020-01-01", periods=len(x)), "x": x, "y": y}) for k, (x, y) in legs.items()])
    rows = pd.concat([rows, pd.DataFrame({"pair_id": ["a"], "dt": [pd.Timestamp("2030-01-01")], "x": [np.nan], "y": [1.0]})])
    return spark.createDataFrame(rows.sample(frac=1, random_state=1)).replace(float("nan"), None)


def welch(x, y, n, step):
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    at = range(0, len(x) - n + 1, step)
    a, b = (np.array([np.fft.rfft((v[i : i + n] - v[i : i + n].mean()) * w) for i in at]) for v in (x, y))
    return len(at), (abs(a) ** 2).mean(0), (abs(b) ** 2).mean(0), (a.conj() * b).mean(0)


def test_cross_spectrum_and_coherence(spark, legs):
    bands = {"all": (0.0, 0.5), "low": (0.05, 0.2), "none": (0.51, 0.6)}
    for n, step in ((32, None), (25, 7)):
        got = {(r.pair_id, r.f): r for r in sp.cross_spectrum(frame(spark, legs), n, step).collect()}
        coh = {(r.pair_id, r.band): r for r in sp.coherence(frame(spark, legs), n, bands, step).collect()}
        assert not any(k == "short" or b == "none" for k, b in coh if (k, b)[0] == "short" or b == "none")
        for name, (x, y) in legs.items():
            if len(x) < n:
                continue
            m, pxx, pyy, pxy = welch(x, y, n, step or n // 2)
            for f in range(n // 2 + 1):
                r = got[name, f]
                assert r.segments == m and np.allclose([r.pxx, r.pyy, r.re, r.im], [pxx[f], pyy[f], pxy[f].real, pxy[f].imag], atol=1e-8)
            for band, (low, high) in list(bands.items())[:2]:
                at = [f for f in range(n // 2 + 1) if low <= f / n <= high]
                r = coh[name, band]
                if name == "flat" or m == 1:
                    assert r.coherence is None
                else:
                    assert abs(r.coherence - np.mean(abs(pxy[at]) ** 2 / (pxx[at] * pyy[at]))) < 1e-8
                    assert abs(r.phase - np.angle(pxy[at].sum())) < 1e-8 and abs(r.power_x - pxx[at].sum() / pxx.sum()) < 1e-8
        # y is x two rows later: it lags by two rows where few cycles wrap.
    narrow = sp.coherence(frame(spark, legs), 32, {"low": (0.03, 0.1)}).where("pair_id = 'a'").first()
    assert -2.6 < narrow.lag < -1.4 and narrow.coherence > 0.5


def test_haar_energy(spark, legs):
    series = frame(spark, legs).selectExpr("pair_id AS symbol", "dt", "x")
    got = {(r.symbol, r.level): r for r in sp.haar_energy(series, "x", 5).collect()}
    for name, (x, _) in legs.items():
        c, level = x.copy(), 1
        while level <= 5 and len(c) >= 4:
            half = len(c) // 2
            even, odd = c[0 : 2 * half : 2], c[1 : 2 * half : 2]
            detail, c = (even - odd) / np.sqrt(2), (even + odd) / np.sqrt(2)
            r = got.pop((name, level))
            assert abs(r.energy - (detail**2).sum()) < 1e-8 and abs(r.amplitude - abs(detail).mean()) < 1e-8 and (r.shortest, r.longest) == (2**level, 2 ** (level + 1))
            assert abs(r.share - (detail**2).sum() / (x**2).sum()) < 1e-9 and r.cycle == (r.share > 0.3)
            level += 1
    assert not got


def test_rolling_band_power(spark, legs):
    bands = {"slow": (0.0, 0.2), "fast": (0.2, 0.5)}
    series = frame(spark, legs).selectExpr("pair_id AS symbol", "dt", "x")
    for n in (16, 21):
        got = {(r.symbol, r.dt, r.band): r.power for r in sp.rolling_band_power(series, "x", n, bands).collect()}
        for name, (x, _) in legs.items():
            days = pd.date_range("2020-01-01", periods=len(x))
            for i in range(n - 1, len(x)):
                p = abs(np.fft.rfft(x[i - n + 1 : i + 1])[1:]) ** 2
                for band, (low, high) in bands.items():
                    at = [f - 1 for f in range(1, n // 2 + 1) if low <= f / n <= high]
                    if name != "flat":
                        assert abs(got[name, days[i].to_pydatetime(), band] - p[at].sum() / p.sum()) < 1e-8
        assert all(k[0] != "short" for k in got) or n == 16
