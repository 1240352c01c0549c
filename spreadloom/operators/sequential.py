"""Statistics that follow a series in time or need a small solver: one Spark group a series or pair, all in parallel.

Each group is one series, so memory is bounded by the longest series. The numerical part of a group is plain numpy on
its ordered values; several statistics share one pass and one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from spreadloom.streaming.jobs import walk

#: MacKinnon's response surfaces for the p-value of a unit-root t with constant, for one and two series:
#: (smallest t, largest t, border, polynomial below the border, polynomial above it).
SURFACES = {
    1: (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-18.86, 0.92, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
#: Critical values at 10, 5, 2.5 and 1 % of the KPSS test around a level; 5 % of Johansen's trace, no trend.
KPSS_LEVELS, KPSS_SHARES, TRACE_5 = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01), (15.4943, 3.8415)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def unit_root_p(t: float, series: int = 1) -> float:
    low, high, border, small, large = SURFACES[series]
    if not math.isfinite(t):
        return math.nan
    if t > high:
        return 1.0
    if t < low:
        return 0.0
    return normal_cdf(sum(c * t**k for k, c in enumerate(small if t <= border else large)))


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares, and the inverse moment matrix."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ (x.T @ y)
    e = y - x @ b
    return b, float(e @ e), inverse


def adf(s: np.ndarray, max_lag: int, constant: bool = True) -> tuple[float, int]:
    """t of the level before and the lag by AIC; all lags are compared on the same rows, then the best on all its rows."""
    d = np.diff(s)

    def fit(lag: int, skip: int) -> tuple[float, float]:
        rows = np.arange(skip, len(d))
        cols = [s[rows], *(d[rows - j] for j in range(1, lag + 1)), *([np.ones(len(rows))] if constant else [])]
        x = np.column_stack(cols)
        if len(rows) <= x.shape[1]:
            return math.nan, math.inf
        b, sse, inverse = least_squares(x, d[rows])
        se = math.sqrt(max(sse, 1e-300) / (len(rows) - x.shape[1]) * max(inverse[0, 0], 0))
        return (b[0] / se if se else math.nan), len(rows) * math.log(max(sse, 1e-300) / len(rows)) + 2 * x.shape[1]

    best = min(range(max_lag + 1), key=lambda lag: fit(lag, max_lag)[1])
    return fit(best, best)[0], best


def johansen(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Trace statistics for no and at most one relation, and the hedge ratio of the first, with one lagged difference."""
    z = np.column_stack([x, y])
    d = np.diff(z, axis=0)
    other = np.column_stack([d[:-1], np.ones(len(d) - 1)])
    out = lambda v: v - other @ (np.linalg.pinv(other) @ v)
    r0, r1 = out(d[1:]), out(z[1:-1])
    n = len(r0)
    s00, s01, s11 = r0.T @ r0 / n, r0.T @ r1 / n, r1.T @ r1 / n
    values, vectors = np.linalg.eig(np.linalg.pinv(s11) @ s01.T @ np.linalg.pinv(s00) @ s01)
    order = np.argsort(-values.real)
    lam, v = np.clip(values.real[order], 0, 1 - 1e-12), vectors.real[:, order[0]]
    return -n * math.log1p(-lam[0]) - n * math.log1p(-lam[1]), -n * math.log1p(-lam[1]), (-v[1] / v[0] if v[0] else math.nan)


def kpss(s: np.ndarray) -> tuple[float, float]:
    """Statistic with the automatic number of Newey-West lags (Hobijn, Franses and Ooms), and its p between 0.01 and 0.10."""
    e = s - s.mean()
    n = len(s)
    products = [e @ e / n, *(2 * (e[j:] @ e[:-j]) / n for j in range(1, int(n ** (2 / 9)) + 1))]
    total = sum(products)
    share = sum(j * v for j, v in enumerate(products)) / total if total else 0.0
    lags = min(n - 1, int(1.1447 * (share * share) ** (1 / 3) * n ** (1 / 3)))
    variance = e @ e / n + sum(2 * (1 - j / (lags + 1)) * (e[j:] @ e[:-j]) / n for j in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * variance)) if variance > 0 else math.nan
    return stat, float(np.interp(stat, KPSS_LEVELS, KPSS_SHARES))


def hurst_rs(s: np.ndarray, max_lag: int = 20) -> float:
    """Slope of the log mean rescaled range on log length, over non-overlapping pieces, within 0 and 1."""
    xs, ys = [], []
    for lag in range(2, max_lag):
        parts = s[: len(s) // lag * lag].reshape(-1, lag)
        dev = np.cumsum(parts - parts.mean(1, keepdims=True), 1)
        sd = parts.std(1, ddof=1)
        rs = (dev.max(1) - dev.min(1))[sd > 0] / sd[sd > 0]
        if len(rs) and rs.mean() > 0:
            xs.append(math.log(lag))
            ys.append(math.log(rs.mean()))
    return float(np.clip(np.polyfit(xs, ys, 1)[0], 0, 1)) if len(xs) > 2 else math.nan


TESTS = "pair_id string, n int, adf_t double, adf_lag int, adf_p double, eg_t double, eg_p double, trace0 double, trace1 double, johansen_hedge double, johansen_ok boolean, kpss double, kpss_p double, hurst double"


def pair_tests(pairs: DataFrame, max_lag: int = 5, least: int = 30) -> DataFrame:
    """Of (pair_id, dt, x, y): unit-root test of the spread, Engle-Granger, Johansen, KPSS and Hurst, in one pass."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        x, y = np.log(np.maximum(rows["x"].to_numpy(), 1e-8)), np.log(np.maximum(rows["y"].to_numpy(), 1e-8))
        n = len(x)
        if n < least or x.std() < 1e-12 or y.std() < 1e-12:
            return pd.DataFrame([(key[0], n, *[None] * 12)], columns=[c.split()[0] for c in TESTS.split(", ")])
        b, _, _ = least_squares(np.column_stack([y, np.ones(n)]), x)
        s = x - y * b[0] - b[1]
        t, lag = adf(s, max_lag)
        eg, _ = adf(s, 1, constant=False)
        trace0, trace1, hedge = johansen(x, y)
        stat, p = kpss(s)
        return pd.DataFrame([(key[0], n, t, lag, unit_root_p(t), eg, unit_root_p(eg, 2), trace0, trace1, hedge, trace0 > TRACE_5[0], stat, p, hurst_rs(s))], columns=[c.split()[0] for c in TESTS.split(", ")])

    return pairs.select("pair_id", "dt", "x", "y").groupBy("pair_id").applyInPandas(run, TESTS)


def kalman_hedge(pairs: DataFrame, obs_cov: float = 1e-3, step_cov: float = 1e-4) -> DataFrame:
    """(pair_id, dt, beta, alpha, error): a random-walk hedge ratio of log x on log y, filtered forward in time."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        x, y = np.log(rows["x"].to_numpy()).tolist(), np.log(rows["y"].to_numpy()).tolist()
        beta, alpha, p, q, r = 1.0, 0.0, 1.0, 0.0, 1.0  # the state, and its covariance (p q; q r)
        out = []
        for target, h in zip(x, y):
            p, r = p + step_cov, r + step_cov
            first, second = h * p + q, h * q + r
            error, scale = target - (h * beta + alpha), h * first + second + obs_cov
            beta, alpha = beta + first / scale * error, alpha + second / scale * error
            p, q, r = p - first / scale * first, q - first / scale * second, r - second / scale * second
            out.append((beta, alpha, error))
        out = np.array(out)
        return pd.DataFrame({"pair_id": key[0], "dt": rows["dt"].to_numpy(), "beta": out[:, 0], "alpha": out[:, 1], "error": out[:, 2]})

    return pairs.select("pair_id", "dt", "x", "y").groupBy("pair_id").applyInPandas(run, "pair_id string, dt date, beta double, alpha double, error double")


def per_series(df: DataFrame, key: str, value: str, out: str, f: Callable[[np.ndarray], dict]) -> DataFrame:
    """A row of numbers for each series, from its ordered values without nulls."""
    kind = df.schema[key].dataType.simpleString()

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: k[0], **f(rows.sort_values("dt")[value].dropna().to_numpy(float))}])

    return df.select(key, "dt", value).groupBy(key).applyInPandas(run, f"{key} {kind}, {out}")


def along_series(df: DataFrame, key: str, value: str, out: str, f: Callable[[np.ndarray], dict]) -> DataFrame:
    """Columns along each series, from its ordered values."""
    kinds = {c.name: c.dataType.simpleString() for c in df.schema}

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        return pd.DataFrame({key: k[0], "dt": rows["dt"].to_numpy(), **f(rows[value].to_numpy(float))})

    return df.select(key, "dt", value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, dt {kinds['dt']}, {out}")


def cusum_chart(df: DataFrame, value: str, threshold: float, drift: float = 0.0, key: str = "symbol") -> DataFrame:
    """Positive and negative sums of changes with reset at zero, and where they pass the threshold."""

    def run(x: np.ndarray) -> dict:
        d = np.diff(x, prepend=x[:1])
        up, down, at = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), int)
        p = n = 0.0
        for k, v in enumerate(d):
            p, n = max(0.0, p + v - drift), max(0.0, n - v - drift)
            up[k], down[k] = p, n
            if p > threshold or n > threshold:
                at[k] = 1 if p > threshold else -1
                p = n = 0.0
        return {"up": up, "down": down, "alarm": at}

    return along_series(df, key, value, "up double, down double, alarm int", run)


def ewma_residual_z(df: DataFrame, value: str, span: int, n: int, key: str = "symbol") -> DataFrame:
    def run(x: np.ndarray) -> dict:
        s = pd.Series(x)
        r = s - s.ewm(span=span, adjust=False).mean()
        return {"z": ((r - r.rolling(n).mean()) / r.rolling(n).std(ddof=0).where(lambda v: v > 1e-12)).to_numpy()}

    return along_series(df, key, value, "z double", run)


def rolling_entropy(df: DataFrame, value: str, n: int, bins: int = 10, key: str = "symbol") -> DataFrame:
    """Shannon entropy of the histogram of each full frame."""

    def run(x: np.ndarray) -> dict:
        out = np.full(len(x), np.nan)
        if len(x) >= n:
            for k, frame in enumerate(np.lib.stride_tricks.sliding_window_view(x, n)):
                if np.isfinite(frame).all():
                    share = np.histogram(frame, bins)[0] / n
                    out[k + n - 1] = -(share[share > 0] * np.log(share[share > 0])).sum()
        return {"entropy": out}

    return along_series(df, key, value, "entropy double", run)


def acf_values(x: np.ndarray, lags: int) -> np.ndarray:
    e = x - x.mean()
    return np.array([1.0, *((e[k:] @ e[:-k]) / (e @ e) for k in range(1, lags + 1))])


def pacf(df: DataFrame, value: str, lags: int, key: str = "symbol") -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion."""

    def run(x: np.ndarray) -> dict:
        r = acf_values(x, lags)
        phi, out = np.zeros(lags + 1), []
        for k in range(1, lags + 1):
            top = r[k] - phi[1:k] @ r[k - 1 : 0 : -1]
            a = top / (1 - phi[1:k] @ r[1:k])
            phi[1:k] = phi[1:k] - a * phi[1:k][::-1]
            phi[k] = a
            out.append(float(a))
        return {"pacf": out}

    return per_series(df, key, value, "pacf array<double>", run)


def ljung_box(df: DataFrame, value: str, lags: int, key: str = "symbol") -> DataFrame:
    def run(x: np.ndarray) -> dict:
        n, r = len(x), acf_values(x, lags)[1:]
        q = n * (n + 2) * (r * r / (n - np.arange(1, lags + 1))).sum()
        return {"q": float(q), "p": chi_square_tail(q, lags)}

    return per_series(df, key, value, "q double, p double", run)


def chi_square_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees > x), from the recursion of the incomplete gamma function."""
    h = x / 2
    if k % 2 == 0:
        term = total = math.exp(-h)
        for j in range(1, k // 2):
            term *= h / j
            total += term
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(h)), math.sqrt(h) * math.exp(-h) / math.gamma(1.5)
    for j in range((k - 1) // 2):
        total += term
        term *= h / (j + 1.5)
    return min(1.0, total)


def huber_z(df: DataFrame, value: str, c: float = 1.345, steps: int = 25, key: str = "symbol") -> DataFrame:
    """Distance of the last value from Huber's location, in deviations by the median absolute deviation."""

    def run(x: np.ndarray) -> dict:
        if len(x) < 3:
            return {"huber_z": None}
        at = np.median(x)
        scale = 1.4826 * np.median(np.abs(x - at))
        if not scale:
            return {"huber_z": None}
        for _ in range(steps):
            away = np.abs(x - at) / scale
            weight = np.where(away <= c, 1.0, c / np.maximum(away, 1e-300))
            at, before = (weight * x).sum() / weight.sum(), at
            if abs(at - before) < 1e-9 * scale:
                break
        return {"huber_z": float((x[-1] - at) / scale)}

    return per_series(df, key, value, "huber_z double", run)


def spectrum(df: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """Length of the strongest cycle, its share of power, and spectral entropy, after taking out the trend."""

    def run(x: np.ndarray) -> dict:
        if len(x) < 8:
            return {"period": None, "share": None, "entropy": None}
        t = np.arange(len(x))
        power = np.abs(np.fft.rfft(x - np.polyval(np.polyfit(t, x, 1), t)))[1:] ** 2
        p = power / power.sum() if power.sum() > 0 else np.full(len(power), 1 / len(power))
        k = int(p.argmax())
        return {"period": len(x) / (k + 1), "share": float(p[k]), "entropy": float(-(p[p > 0] * np.log(p[p > 0])).sum() / math.log(len(p)))}

    return per_series(df, key, value, "period double, share double, entropy double", run)


def sample_entropy(df: DataFrame, value: str, m: int = 2, r: float = 0.2, key: str = "symbol") -> DataFrame:
    def run(x: np.ndarray) -> dict:
        tolerance = r * x.std()

        def matches(length: int) -> int:
            v = np.lib.stride_tricks.sliding_window_view(x, length)[: len(x) - m]
            return sum(int((np.abs(v[k + 1 :] - v[k]).max(1) <= tolerance).sum()) for k in range(len(v) - 1))

        a, b = (matches(m + 1), matches(m)) if len(x) > m + 2 else (0, 0)
        return {"sampen": -math.log(a / b) if a and b else None}

    return per_series(df, key, value, "sampen double", run)


def per_pair(pairs: DataFrame, out: str, f: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
    """A row of numbers for each pair, from its ordered legs."""

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        return pd.DataFrame([{"pair_id": k[0], **f(rows["x"].to_numpy(float), rows["y"].to_numpy(float))}])

    return pairs.select("pair_id", "dt", "x", "y").groupBy("pair_id").applyInPandas(run, f"pair_id string, {out}")


def distance_sums(v: np.ndarray) -> np.ndarray:
    """The sum of distances of each value to all others, from sorted running sums."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    before = np.cumsum(s) - s
    out = np.empty(len(v))
    k = np.arange(len(v))
    out[order] = s * k - before + (s.sum() - before - s) - s * (len(v) - 1 - k)
    return out


def distance_products(x: np.ndarray, y: np.ndarray) -> float:
    """Sum over all pairs of rows of |x - x'| |y - y'|, by merge counting: rows are in order of x, and at each level the rows
    of a right half meet those of its left half with smaller y as running sums in order of y."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n, by_y, place = len(x), np.argsort(y, kind="stable"), np.arange(len(x))
    values = np.column_stack([np.ones(n), x, y, x * y])
    smaller, w = np.zeros((n, 4)), 1
    while w < n:
        block = by_y // (2 * w)
        at = by_y[np.argsort(block, kind="stable")]  # by block, then y
        left = (at // w) % 2 == 0
        sums = np.cumsum(np.where(left[:, None], values[at], 0.0), axis=0)
        first = np.searchsorted(at // (2 * w), place // (2 * w))  # where a row's block begins
        base = np.vstack([np.zeros(4), sums])[first[at]]
        smaller[at[~left]] += (sums - base)[~left]
        w *= 2
    every = np.cumsum(values, axis=0) - values
    meet = lambda s: x * y * s[:, 0] - x * s[:, 2] - y * s[:, 1] + s[:, 3]
    return float(2 * (2 * meet(smaller) - meet(every)).sum())


def distance_covariance(x: np.ndarray, y: np.ndarray) -> float:
    """Squared distance covariance of rows, from sums; no matrix of pairs."""
    n, a, b = len(x), distance_sums(x), distance_sums(y)
    return distance_products(x, y) / n**2 + (a.sum() / n**2) * (b.sum() / n**2) - 2 * float(a @ b) / n**3


def distance_correlation(pairs: DataFrame) -> DataFrame:
    """In time n log^2 n and memory n for a pair of n rows."""

    def run(x: np.ndarray, y: np.ndarray) -> dict:
        sx, sy = x.std(), y.std()
        if not (len(x) > 1 and sx > 0 and sy > 0):
            return {"dcor": None}
        x, y = (x - x.mean()) / sx, (y - y.mean()) / sy
        scale = math.sqrt(max(0.0, distance_covariance(x, x)) * max(0.0, distance_covariance(y, y)))
        return {"dcor": math.sqrt(max(0.0, distance_covariance(x, y)) / scale) if scale > 0 else None}

    return per_pair(pairs, "dcor double", run)


def granger(pairs: DataFrame, lags: int = 2) -> DataFrame:
    """F of adding the lags of one leg's changes to the other's own, both ways."""

    def f_of(a: np.ndarray, b: np.ndarray) -> float | None:
        n = len(b) - lags
        if n <= 2 * lags + 2:
            return None
        own = np.column_stack([np.ones(n), *(b[lags - k : len(b) - k] for k in range(1, lags + 1))])
        both = np.column_stack([own, *(a[lags - k : len(a) - k] for k in range(1, lags + 1))])
        _, less, _ = least_squares(own, b[lags:])
        _, more, _ = least_squares(both, b[lags:])
        return float((less - more) / lags / (more / (n - both.shape[1])))

    def run(x: np.ndarray, y: np.ndarray) -> dict:
        dx, dy = np.diff(np.log(x)), np.diff(np.log(y))
        return {"f_x_to_y": f_of(dx, dy), "f_y_to_x": f_of(dy, dx)}

    return per_pair(pairs, "f_x_to_y double, f_y_to_x double", run)


def warped(a: np.ndarray, b: np.ndarray, band: int) -> float:
    """Distance by dynamic time warping within a band, by anti-diagonals: all cells of one are found at once from the two
    before."""
    n, m = len(a), len(b)
    one, two = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # the diagonals before, at i + 1
    for s in range(n + m - 1):
        low, high = max(0, s - m + 1, -((band - s) // 2)), min(n - 1, s, (s + band) // 2)
        new = np.full(n + 1, np.inf)
        if low <= high:
            i = slice(low, high + 1)
            cost = np.abs(a[i] - b[s - high : s - low + 1][::-1])
            best = np.minimum(np.minimum(one[i], one[low + 1 : high + 2]), two[i]) if s else 0.0
            new[low + 1 : high + 2] = cost + best
        one, two = new, one
    return float(one[n])


def time_warping(pairs: DataFrame, band: int = 10) -> DataFrame:
    """Distance of the standardised legs by dynamic time warping within a band."""

    def run(x: np.ndarray, y: np.ndarray) -> dict:
        a, b = ((v - v.mean()) / (v.std() or 1.0) for v in (x, y))
        return {"dtw": warped(a, b, band)}

    return per_pair(pairs, "dtw double", run)


def trade_episodes(zs: DataFrame, entry: float = 2.0, exit_: float = 0.5, stop: float = 4.0, max_hold: int = 30) -> DataFrame:
    """(pair_id, dt, event, direction, pnl_z): the batch twin of the streaming episodes, by the same transitions."""

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = walk(rows.sort_values("dt").rename(columns={"dt": "ts"}), 0, 0, 0.0, entry, exit_, stop, max_hold)
        return pd.DataFrame([(k[0], *x) for x in out], columns=["pair_id", "dt", "event", "direction", "pnl_z"])

    return zs.select("pair_id", "dt", "z").groupBy("pair_id").applyInPandas(run, "pair_id string, dt date, event string, direction int, pnl_z double")


def mahalanobis(wide: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Distance of each row to the mean and covariance of the n rows before it; a row is a date, so this is one series."""

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        v = rows[columns].to_numpy(float)
        out = np.full(len(v), np.nan)
        for i in range(n, len(v)):
            past = v[i - n : i]
            if np.isfinite(v[i - n : i + 1]).all():
                d = v[i] - past.mean(0)
                out[i] = math.sqrt(max(0.0, d @ np.linalg.pinv(np.cov(past, rowvar=False)) @ d))
        return pd.DataFrame({"book": k[0], "dt": rows["dt"].to_numpy(), "distance": out})

    return wide.select("book", "dt", *columns).groupBy("book").applyInPandas(run, "book string, dt date, distance double")
