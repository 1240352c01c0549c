"""Universe-level jobs: signal tables, fundamental scores, adjustments, attribution, and set comparisons."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import clip, correlation, ordered, ratio, slope, so_far, trailing, zscore
from spreadloom.operators.tables import ranked, settled


def signal_table(pairs: DataFrame, n: int, extreme: float = 2.0) -> DataFrame:
    """Latest state of every pair: rolling-beta spread, its z, rolling correlation, score, rank, core and extreme flags."""
    w = trailing(n, "pair_id")
    b = slope("y", "x", w)
    s = pairs.select("pair_id", "dt", "x", "y", F.when(F.count("*").over(w) == n, F.col("y") - b * F.col("x")).alias("spread"), F.when(F.count("*").over(w) == n, correlation("x", "y", w)).alias("corr"))
    z = s.withColumn("z", zscore("spread", w, n))
    last = z.groupBy("pair_id").agg(F.max_by(F.struct("dt", "z", "corr"), "dt").alias("l")).select("pair_id", "l.*").where("z IS NOT NULL")
    scored = last.withColumn("score", F.abs("z") * (0.5 + 0.5 * F.coalesce(F.abs("corr"), F.lit(0.0))))
    placed = ranked(settled(scored), F.round("score", 9), "pair_id")
    return placed.withColumn("is_core", F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("n_ranked") * 0.2))).withColumn("is_extreme", F.abs("z") >= extreme).drop("n_ranked")


def signal_summary(signals: DataFrame) -> DataFrame:
    return signals.agg(F.count("*").alias("n"), F.avg(F.abs("z")).alias("mean_abs_z"), F.max(F.abs("z")).alias("max_abs_z"), F.avg("corr").alias("mean_corr"), F.count_if("is_core").alias("n_core"), F.count_if("is_extreme").alias("n_extreme"))


def for_execution(signals: DataFrame, least_z: float, windows: Sequence[tuple[float, str]]) -> DataFrame:
    """Rows with |z| at least so large, tagged by the first window whose bound they reach."""
    tag = F.coalesce(*[F.when(F.abs("z") >= b, F.lit(n)) for b, n in windows], F.lit("later"))
    return signals.where(F.abs("z") >= least_z).withColumn("window", tag)


def fundamental_scores(df: DataFrame, fields: dict[str, tuple[float, bool]], key: Sequence[str] = ("dt",)) -> DataFrame:
    """Percentile of each winsorised field within its date, inverted where low is good, and the weighted mean of those
    that are present. fields: name -> (weight, low is good)."""
    w = Window.partitionBy(*key)
    cut = df.select("*", *[clip(f, F.percentile(f, 0.05).over(w), F.percentile(f, 0.95).over(w)).alias(f"_{f}") for f in fields])
    scored = cut.select("*", *[F.when(F.col(f"_{f}").isNotNull(), _percentile(f"_{f}", key, low)).alias(f"{f}_score") for f, (_, low) in fields.items()])
    total = sum(F.when(F.col(f"{f}_score").isNotNull(), wt).otherwise(0.0) for f, (wt, _) in fields.items())
    return scored.drop(*[f"_{f}" for f in fields]).withColumn("composite", ratio(sum(F.coalesce(F.col(f"{f}_score") * wt, F.lit(0.0)) for f, (wt, _) in fields.items()), total))


def _percentile(c: str, key: Sequence[str], low_is_good: bool) -> Column:
    up = F.rank().over(Window.partitionBy(*key).orderBy(F.col(c).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*key, c)) - 1) / 2
    p = 100 * up / F.count(c).over(Window.partitionBy(*key))
    return 100 - p if low_is_good else p


def risk_overlay(df: DataFrame, score: str, risks: dict[str, float], most: float = 20.0) -> DataFrame:
    """Score less a penalty of 0 to ``most``: weighted robust z of the risks, not below zero, rescaled over the panel."""
    marks = df.agg(*[F.percentile(c, [0.25, 0.5, 0.75]).alias(f"_of_{c}") for c in risks])  # one row

    def z(c: str) -> Column:
        low, middle, high = (F.col(f"_of_{c}")[i] for i in range(3))
        return F.greatest(F.lit(0.0), F.coalesce(ratio(F.col(c) - middle, (high - low) / 1.349), F.lit(0.0)))

    raw = df.crossJoin(F.broadcast(marks)).select(*df.columns, sum(weight * z(c) for c, weight in risks.items()).alias("_raw"))
    ends = raw.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = raw.crossJoin(F.broadcast(ends)).withColumn("penalty", F.when(hi > lo, most * (F.col("_raw") - lo) / (hi - lo)).otherwise(0.0))
    return scaled.withColumn("adjusted", clip(F.col(score) - F.col("penalty"), 0.0, 100.0)).drop("_raw", "_lo", "_hi")


def macro_adjusted(pairs: DataFrame, regimes: DataFrame, multipliers: dict[str, float], enter: float, leave: float, key: str = "pair_id") -> DataFrame:
    """Exposure by the regime of the date and an include flag with hysteresis: it turns on at ``enter`` and off below
    ``leave``; between them the last decision holds."""
    m = F.create_map(*[x for k, v in multipliers.items() for x in (F.lit(k), F.lit(v))])
    j = pairs.join(regimes, "dt", "left").withColumn("multiplier", F.coalesce(F.try_element_at(m, F.col("regime")), F.lit(1.0))).withColumn("fit", F.col("score") * F.col("multiplier"))
    edge = F.when(F.col("fit") >= enter, True).when(F.col("fit") < leave, False)
    return j.withColumn("include", F.coalesce(F.last(edge, True).over(so_far(key)), F.lit(False)))


def regime_probabilities(regimes: DataFrame, labels: Sequence[str], n: int = 5) -> DataFrame:
    """Share of each label over the last n rows."""
    w = Window.partitionBy(F.lit(0)).orderBy("dt").rowsBetween(1 - n, 0)
    return regimes.select("dt", "regime", *[F.avg((F.col("regime") == x).cast("double")).over(w).alias(f"p_{x}") for x in labels])


def mean_gaps(profiles: DataFrame, key: str, value: str) -> DataFrame:
    """(id, mean_distance): mean of |v - other v| over all other profiles, from ranks and sums so far of the ordered values,
    not from pairs. One row a profile."""
    o = Window.partitionBy(F.lit(0)).orderBy(value, key).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    d = profiles.where(F.col(value).isNotNull()).select(F.col(key).alias("id"), F.col(value).alias("v"), F.count("*").over(o).alias("k"), F.sum(value).over(o).alias("low"), F.count("*").over(every).alias("n"), F.sum(value).over(every).alias("all"))
    gaps = F.col("v") * F.col("k") - F.col("low") + (F.col("all") - F.col("low")) - F.col("v") * (F.col("n") - F.col("k"))
    return d.select("id", ratio(gaps, F.col("n") - 1).alias("mean_distance"))


def profile_anomalies(mean: DataFrame, bound: float) -> DataFrame:
    """(id, mean_distance) as a z over all profiles, and whether it reaches the bound."""
    w = Window.partitionBy(F.lit(0))
    return mean.withColumn("z", ratio(F.col("mean_distance") - F.avg("mean_distance").over(w), F.stddev_pop("mean_distance").over(w))).withColumn("is_anomaly", F.coalesce(F.col("z") >= bound, F.lit(False)))


def champion_against(metrics: DataFrame, champion: str, challenger: str, auc_lift: float = 0.01, brier_cut: float = 0.005) -> DataFrame:
    """(key, model, auc, brier) of two models: lifts, and whether to promote."""
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    g = metrics.groupBy("key").agg((pick(challenger, "auc") - pick(champion, "auc")).alias("auc_lift"), (pick(champion, "brier") - pick(challenger, "brier")).alias("brier_cut"))
    return g.withColumn("promote", (F.col("auc_lift") > auc_lift) & (F.col("brier_cut") > brier_cut))


def missing_features(df: DataFrame, required: Sequence[str], bound: float) -> DataFrame:
    """Share of required features that a row lacks, absent columns included, and whether it is usable."""
    have = [c for c in required if c in df.columns]
    n = sum(F.col(c).isNull().cast("int") for c in have) + (len(required) - len(have))
    return df.withColumn("missing_share", n / F.lit(float(len(required)))).withColumn("usable", F.col("missing_share") <= bound)


def worst_window(pnl: DataFrame) -> DataFrame:
    """(peak_dt, trough_dt, depth) of the worst drawdown of the total of (dt, pnl): one row."""
    total = pnl.groupBy("dt").agg(F.sum("pnl").alias("pnl"))
    o = Window.partitionBy(F.lit(0)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    path = total.withColumn("cum", F.sum("pnl").over(o)).withColumn("peak", F.max("cum").over(o))
    path = path.withColumn("peak_dt", F.last(F.when(F.col("cum") == F.col("peak"), F.col("dt")), True).over(o))
    return path.agg(F.min_by(F.struct("dt", "peak_dt"), F.struct(F.col("cum") - F.col("peak"), "dt")).alias("w"), F.min(F.col("cum") - F.col("peak")).alias("depth")).select("w.peak_dt", F.col("w.dt").alias("trough_dt"), "depth")


def drawdown_attribution(pnl: DataFrame, key: str = "pair") -> DataFrame:
    """Each member's pnl between peak and trough of the worst drawdown of the total, and its share of the fall.
    pnl: (key, dt, pnl)."""
    inside = pnl.join(F.broadcast(worst_window(pnl)), (F.col("dt") > F.col("peak_dt")) & (F.col("dt") <= F.col("trough_dt")))
    return inside.groupBy(key).agg(F.sum("pnl").alias("pnl"), F.first("depth").alias("depth")).withColumn("share", ratio(F.least("pnl", F.lit(0.0)), "depth")).drop("depth")


def opportunities(df: DataFrame, parts: dict[str, float], held: DataFrame, penalty: float, floor: float) -> DataFrame:
    """Weighted 0-1 dimensions, less a penalty for every leg that is held already; above the floor, ranked."""
    legs = df.select("pair", F.explode(F.array("leg_x", "leg_y")).alias("symbol")).join(held.select("symbol").distinct(), "symbol", "left_semi").groupBy("pair").agg(F.count("*").alias("overlap"))
    score = sum(w * clip(c, 0.0, 1.0) for c, w in parts.items())
    j = df.join(legs, "pair", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0))).withColumn("score", score - penalty * F.col("overlap")).where(F.col("score") >= floor)
    return ranked(j, F.round("score", 9), "pair").drop("n_ranked")


def dynamic_limits(state: DataFrame, base: float, key: str) -> DataFrame:
    """Limit scaled down by volatility and drawdown, and the size factor of a 0-100 risk score. state: (key, vol, drawdown)."""
    risk = clip(100 * (0.6 * F.least(F.col("vol") / 0.4, F.lit(1.0)) + 0.4 * F.least(-F.col("drawdown") / 0.3, F.lit(1.0))), 0.0, 100.0)
    return state.select(key, "vol", "drawdown", risk.alias("risk_score")).withColumn("scale", clip(1 - F.col("risk_score") / 100, 0.2, 1.0)).withColumn("limit", base * F.col("scale"))


def coverage_compared(df: DataFrame, flag: Column, fields: Sequence[str]) -> DataFrame:
    """Per field: mean and median in universe A and B, and the difference of the means, in one pass."""
    long = df.select(flag.alias("a"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])))
    inside, outside = F.when(F.col("a"), F.col("v")), F.when(~F.col("a"), F.col("v"))
    return long.groupBy("field").agg(F.avg(inside).alias("mean_a"), F.avg(outside).alias("mean_b"), F.percentile(inside, 0.5).alias("median_a"), F.percentile(outside, 0.5).alias("median_b")).withColumn("diff", F.col("mean_a") - F.col("mean_b"))


def geometric_score(df: DataFrame, metrics: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Product of normalised metrics to the power of their weights. metrics: name -> (low, high, weight)."""
    total = sum(w for _, _, w in metrics.values())
    unit = lambda c, lo, hi: clip((F.col(c) - lo) / (hi - lo), 0.0, 1.0)
    log = sum(w / total * F.ln(F.greatest(unit(c, lo, hi), F.lit(1e-9))) for c, (lo, hi, w) in metrics.items())
    mean = sum(w / total * unit(c, lo, hi) for c, (lo, hi, w) in metrics.items())
    return df.select("*", F.exp(log).alias("geometric"), mean.alias("weighted"))


def combined(df: DataFrame, pairs: Sequence[tuple[str, str]], f: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """f of each pair of columns, as one select."""
    return df.select("*", *[f(F.col(a), F.col(b)).alias(f"{a}_{name}_{b}") for a, b in pairs])


def folded(m: DataFrame, key: str, cell: Callable[[Column], Column], start: float, step: Callable[[Column, Column], Column]) -> DataFrame:
    """A function of every cell of a matrix column, and the fold of all results."""
    done = F.transform("matrix", lambda row: F.transform(row, lambda v: cell(F.coalesce(v, F.lit(0.0)))))
    return m.select(key, done.alias("matrix"), F.aggregate(F.flatten(done), F.lit(float(start)), step).alias("folded"))


def anomaly_votes(df: DataFrame, n: int, z: float, iqr: float, key: str = "symbol", value: str = "log_ret") -> DataFrame:
    """Rows where |z| or |iqr score| of the rolling frame is beyond its bound."""
    w = trailing(n, key)
    score = ratio(F.col(value) - F.percentile(value, 0.5).over(w), (F.percentile(value, 0.75).over(w) - F.percentile(value, 0.25).over(w)) / 1.349)
    out = df.select("*", zscore(value, w, n).alias("z"), F.when(F.count(value).over(w) == n, score).alias("iqr"))
    return out.where((F.abs("z") > z) | (F.abs("iqr") > iqr))


def adaptive_thresholds(df: DataFrame, entry: float = 2.0, exit_: float = 0.5, stop: float = 4.0) -> DataFrame:
    """Entry, exit and stop scaled by the ratio of current to base volatility, exit capped by half-life, kept in order."""
    m = clip(ratio("vol", "base_vol"), 0.5, 2.0)
    e, s = entry * m, stop * F.greatest(m, F.lit(1.0))
    x = F.when(F.col("half_life") < 5, F.least(exit_ * F.least(m, F.lit(1.5)), F.lit(0.2))).when(F.col("half_life") > 60, F.greatest(exit_ * F.least(m, F.lit(1.5)), F.lit(0.8))).otherwise(exit_ * F.least(m, F.lit(1.5)))
    return df.select("*", e.alias("entry"), F.least(x, e).alias("exit"), F.greatest(s, e).alias("stop"))


def flattened(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """Fields of a struct column as columns with dotted names."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{f}").alias(f"{column}{sep}{f}") for f in df.schema[column].dataType.names])


def merged_maps(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Two map columns as one; the right side wins."""
    keep = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return df.withColumn(name, F.map_concat(keep, right))


def deflated_sharpe(sharpe: Column, n_trials: int, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that a per-period Sharpe exceeds the expected best of n trials (excess kurtosis), with a logistic
    approximation of the normal distribution function of absolute error below 2e-4."""
    e = math.exp(1)
    ppf = lambda p: math.sqrt(2) * _erfinv(2 * p - 1)
    best = (1 - 0.5772156649) * ppf(1 - 1 / n_trials) + 0.5772156649 * ppf(1 - 1 / (n_trials * e)) if n_trials > 1 else 0.0
    se = F.sqrt((1 - skew * sharpe + (kurt + 2) / 4 * sharpe * sharpe) / (n - 1))
    x = (sharpe - best / F.sqrt(n - 1)) / se
    return 1 / (1 + F.exp(-x * (1.5976 + 0.070565992 * x * x)))


def _erfinv(y: float) -> float:
    x = 0.0
    for _ in range(60):  # Newton
        x -= (math.erf(x) - y) / (2 / math.sqrt(math.pi) * math.exp(-x * x))
    return x
