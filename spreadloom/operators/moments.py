"""What follows from means and covariances of several columns: penalised regressions, distances and principal components,
for all keys in one job.

Moments of a key are one aggregate with partial sums; moments of a moving window are differences of running sums, so a row
costs the same whatever the window. Small matrices are then solved many at once, a batch of rows of numpy arrays; no
series and no key's rows are collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import ordered


def pairs_of(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def moments(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, n, mean, cov): means and population covariances (i <= j, row by row) over rows without missing values."""
    rows = whole_rows(df, columns)
    covs = [F.covar_pop(columns[i], columns[j]) for i, j in pairs_of(len(columns))]
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*covs).alias("cov"))


def whole_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every column has a finite value."""
    return df.where(F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))


def rolling_moments(df: DataFrame, key: str, columns: Sequence[str], n: int, ago: int = 0) -> DataFrame:
    """(key, dt, values, mean, cov) of whole rows: moments as above of the n rows that end ``ago`` rows before, null where
    there are fewer. The key's means are taken out of the sums and put back, which keeps differences exact enough."""
    whole, line = Window.partitionBy(key), ordered(key)
    rows = whole_rows(df, columns).select(key, "dt", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    rows = rows.withColumns({f"_m{i}": F.avg(f"_v{i}").over(whole) for i in range(len(columns))} | {"_k": F.row_number().over(line)})
    away = [F.col(f"_v{i}") - F.col(f"_m{i}") for i in range(len(columns))]
    terms = {f"_s{i}": a for i, a in enumerate(away)} | {f"_p{i}_{j}": away[i] * away[j] for i, j in pairs_of(len(columns))}
    running = rows.withColumns({name: F.sum(term).over(line.rowsBetween(Window.unboundedPreceding, 0)) for name, term in terms.items()})
    upto = lambda name, lag: F.coalesce(F.lag(name, lag).over(line) if lag else F.col(name), F.lit(0.0))
    running = running.withColumns({name: (upto(name, ago) - upto(name, ago + n)) / n for name in terms})
    full = F.col("_k") >= n + ago
    mean = F.array(*[F.col(f"_m{i}") + F.col(f"_s{i}") for i in range(len(columns))])
    cov = F.array(*[F.col(f"_p{i}_{j}") - F.col(f"_s{i}") * F.col(f"_s{j}") for i, j in pairs_of(len(columns))])
    values = F.array(*[F.col(f"_v{i}") for i in range(len(columns))])
    return running.select(key, "dt", values.alias("values"), F.when(full, mean).alias("mean"), F.when(full, cov).alias("cov"))


def symmetric(rows: pd.Series, k: int) -> np.ndarray:
    """Arrays of the upper halves as matrices, one a row."""
    flat = np.array(rows.tolist(), float).reshape(len(rows), k * (k + 1) // 2)
    out = np.empty((len(rows), k, k))
    for at, (i, j) in enumerate(pairs_of(k)):
        out[:, i, j] = out[:, j, i] = flat[:, at]
    return out


def solved(df: DataFrame, out: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Batches of rows through f; an empty batch gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield f(rows)

    return df.mapInPandas(run, out)


def inverses(cov: np.ndarray) -> np.ndarray:
    """Inverses of covariances, NaN where one is singular, to the precision of its own scale."""
    sd = np.sqrt(np.maximum(np.einsum("bii->bi", cov), 0))
    scale = np.where(sd > 0, sd, 1.0)
    corr = cov / (scale[:, :, None] * scale[:, None, :])
    fine = (sd > 0).all(axis=1) & (np.linalg.eigvalsh(corr)[:, 0] > 1e-10)
    out = np.full(cov.shape, np.nan)
    if fine.any():
        out[fine] = np.linalg.inv(corr[fine]) / (scale[fine, :, None] * scale[fine, None, :])
    return out


def distances(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, dt, distance): Mahalanobis distance of each whole row to the mean and sample covariance of its key's rows; null
    where these are singular. A key's inverse is solved once, from its moments; the distance is a column expression."""
    k = len(columns)
    types = f"{key} {kind(df, key)}, mean array<double>, inverse array<double>"

    def invert(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy(float)
        inverse = inverses(symmetric(rows["cov"], k) * (n / np.maximum(n - 1, 1))[:, None, None])
        flat = [None if np.isnan(m).any() else m.ravel() for m in inverse]
        return pd.DataFrame({key: rows[key], "mean": rows["mean"], "inverse": flat})

    inverse = solved(moments(df, key, columns), types, invert)
    away = F.transform(F.array(*[F.col(c).cast("double") for c in columns]), lambda v, i: v - F.col("mean")[i])
    joined = whole_rows(df, columns).join(inverse, key).withColumn("_d", away)
    return joined.select(key, "dt", F.when(F.col("inverse").isNotNull(), F.sqrt(F.greatest(quadratic("_d", "inverse", k), F.lit(0.0)))).alias("distance"))


def quadratic(v: str, m: str, k: int) -> Column:
    """v' M v, with M flat."""
    terms = [F.col(v)[i] * F.col(v)[j] * F.col(m)[i * k + j] for i in range(k) for j in range(k)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def rolling_distances(df: DataFrame, key: str, columns: Sequence[str], n: int) -> DataFrame:
    """(key, dt, distance): Mahalanobis distance of each whole row to mean and sample covariance of the n rows before it,
    itself not included; null where there are fewer or they are singular."""
    k = len(columns)

    def distance(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full(len(rows), np.nan)
        has = rows["cov"].notna().to_numpy()
        if has.any():
            part = rows[has]
            away = np.array(part["values"].tolist(), float) - np.array(part["mean"].tolist(), float)
            squared = np.einsum("bi,bij,bj->b", away, inverses(symmetric(part["cov"], k) * n / max(n - 1, 1)), away)
            out[has] = np.sqrt(np.maximum(squared, 0))
        return pd.DataFrame({key: rows[key], "dt": rows["dt"], "distance": out})

    found = solved(rolling_moments(df, key, columns, n, 1), f"{key} {kind(df, key)}, dt {kind(df, 'dt')}, distance double", distance)
    return found.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def rolling_components(df: DataFrame, key: str, columns: Sequence[str], n: int, components: int) -> DataFrame:
    """(key, dt, explained, ratio, residual_sd): principal components of the last n whole rows of each key: the shares of
    variance of the first components, their sum, and the deviation of what they leave, over all columns and rows of the
    window. Null before there are n rows; ratios are null for a window without variance. At most one component less than
    there are columns is taken."""
    k = len(columns)
    m = min(components, k - 1)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        explained, ratio, sd = [None] * len(rows), np.full(len(rows), np.nan), np.full(len(rows), np.nan)
        has = np.flatnonzero(rows["cov"].notna().to_numpy())
        if len(has):
            values = np.maximum(np.linalg.eigvalsh(symmetric(rows["cov"].iloc[has], k))[:, ::-1], 0)
            total = values.sum(axis=1)
            sd[has] = np.sqrt(values[:, m:].sum(axis=1) / k)
            for at, v, t in zip(has, values, total):
                if t > 0:
                    explained[at], ratio[at] = v[:m] / t, v[:m].sum() / t
        return pd.DataFrame({key: rows[key], "dt": rows["dt"], "explained": explained, "ratio": ratio, "residual_sd": sd})

    types = f"{key} {kind(df, key)}, dt {kind(df, 'dt')}, explained array<double>, ratio double, residual_sd double"
    found = solved(rolling_moments(df, key, columns, n), types, fit)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ratio", "residual_sd")})


def guarded(data: DataFrame, train_end: str, at: str = "dt") -> DataFrame:
    """The data, once no row of it is later than the end of training; else an error, so that no model sees its future."""
    end = F.lit(train_end).cast("date")
    latest, late = data.agg(F.max(at), F.max(at) > end).first()
    if late:
        raise ValueError(f"training data up to {latest} after {train_end}")
    return data


def descent(c: np.ndarray, b: np.ndarray, start: np.ndarray, l1: float, l2: float, tol: float = 1e-12, sweeps: int = 10_000) -> np.ndarray:
    """Coordinate descent for many systems at once: least b'Cb/2 - c'b + l1 |b| + l2 b'b/2, with C of unit diagonal (or zero
    where a column is constant). Only moments are touched (covariance updates)."""
    beta = start.copy()
    gradient = b - np.einsum("bij,bj->bi", c, beta)
    live = np.einsum("bii->bi", c) > 0
    for _ in range(sweeps):
        moved = 0.0
        for j in range(c.shape[1]):
            pull = gradient[:, j] + c[:, j, j] * beta[:, j]
            new = np.where(live[:, j], np.sign(pull) * np.maximum(np.abs(pull) - l1, 0) / (c[:, j, j] + l2 + (~live[:, j])), 0.0)
            step = new - beta[:, j]
            gradient -= c[:, :, j] * step[:, None]
            beta[:, j] = new
            moved = max(moved, float(np.abs(step).max(initial=0.0)))
        if moved < tol:
            break
    return beta


def elastic_net(data: DataFrame, key: str, y: str, features: Sequence[str], penalties: Sequence[float], l1_ratio: float, train_end: str) -> DataFrame:
    """(key, penalty, feature, n, coefficient, weight, intercept, r2): elastic nets of y on the features for each key and
    penalty, over whole rows up to ``train_end``; later rows are an error. The loss is half the mean squared error plus
    penalty * (l1_ratio * sum |w| + (1 - l1_ratio) / 2 * sum w^2), on features of unit deviation, whose coefficients are
    ``weight``; ``coefficient`` is of the feature as given. A ratio of 0 is ridge, 1 is lasso. Penalties are walked from the
    largest down, each from the solution before. Constant features get 0; keys without two rows or with a constant y
    have no rows."""
    k, names = len(features), [*features, y]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        cov, mean, out = symmetric(rows["cov"], k + 1), np.array(rows["mean"].tolist(), float), []
        use = (cov[:, k, k] > 0) & (rows["n"] >= 2).to_numpy()
        rows, cov, mean = rows[use], cov[use], mean[use]
        sd = np.sqrt(np.einsum("bii->bi", cov)[:, :k])
        scale = np.where(sd > 1e-12 * np.maximum(np.abs(mean[:, :k]), 1e-300), sd, np.inf)
        c, b = cov[:, :k, :k] / (scale[:, :, None] * scale[:, None, :]), cov[:, :k, k] / scale
        beta = np.zeros((len(rows), k))
        for penalty in sorted(penalties, reverse=True):
            beta = descent(c, b, beta, penalty * l1_ratio, penalty * (1 - l1_ratio))
            coefficient = beta / scale
            intercept = mean[:, k] - (coefficient * mean[:, :k]).sum(axis=1)
            left = cov[:, k, k] - 2 * (b * beta).sum(axis=1) + np.einsum("bi,bij,bj->b", beta, c, beta)
            for i, (name, n) in enumerate(zip(rows[key], rows["n"])):
                r2 = 1 - left[i] / cov[i, k, k]
                out += [(name, penalty, f, n, coefficient[i, j], beta[i, j], intercept[i], r2) for j, f in enumerate(features)]
        return pd.DataFrame(out, columns=[key, "penalty", "feature", "n", "coefficient", "weight", "intercept", "r2"])

    types = f"{key} {kind(data, key)}, penalty double, feature string, n long, coefficient double, weight double, intercept double, r2 double"
    return solved(moments(guarded(data, train_end), key, names), types, fit)


def linear_scores(rows: DataFrame, model: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Rows with ``score`` by their key's model of one penalty; null where a feature is missing or the key has no model."""
    one = model.groupBy(key).agg(F.max("intercept").alias("_b"), *[F.max(F.when(F.col("feature") == f, F.col("coefficient"))).alias(f"_c{i}") for i, f in enumerate(features)])
    score = F.col("_b")
    for i, f in enumerate(features):
        score = score + F.col(f"_c{i}") * F.col(f)
    return rows.join(one, key, "left").select(*rows.columns, score.alias("score"))
