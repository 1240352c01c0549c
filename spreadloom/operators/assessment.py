"""Operators that assess scores, strategies and limits: significance of a Sharpe ratio, neutral scores, caps in order,
stress of a drawdown, permutation tests, datasets with their checks, and limits that tighten."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import clip, correlation, ordered, ratio, so_far
from spreadloom.operators.universe import worst_window


def normal_cdf(x: Column) -> Column:
    """Logistic approximation, within 2e-4 of the distribution function."""
    return 1 / (1 + F.exp(-x * (1.5976 + 0.070565992 * x * x)))


def sharpe_significance(stats: DataFrame, trials: int, alpha: float = 0.05) -> DataFrame:
    """p-value of a Sharpe ratio and the least number of observations at which it is significant among so many trials.
    stats: n, sr, skew and kurt (excess). Fewer than four observations or no ratio: p is 1; a ratio of zero needs endless
    observations."""
    s, n = F.col("sr"), F.col("n")
    spread = 1 - F.col("skew") * s + F.col("kurt") / 4 * s * s
    spread = F.when(spread > 0, spread).otherwise(1.0)
    z = NormalDist().inv_cdf(1 - alpha / trials)
    p = F.when(s.isNull() | (n < 4), 1.0).otherwise(1 - normal_cdf(s / F.sqrt(spread / (n - 1))))
    least = F.when(s.isNull() | (F.abs(s) < 1e-9), float("inf")).otherwise(F.greatest(F.lit(1.0), 1 + spread * F.pow(z / s, 2)))
    return stats.withColumns({"p": p, "least_n": least}).withColumn("is_long_enough", n >= F.col("least_n"))


def factor_neutral(df: DataFrame, score: str, exposures: Sequence[str], strength: float = 0.5, most: float = 20.0) -> DataFrame:
    """Score less a share of a penalty of 0 to ``most``: the sum of absolute exposures, rescaled over the panel. A missing
    exposure counts nothing; without any spread of exposures scores stay."""
    raw = df.withColumn("_raw", sum(F.coalesce(F.abs(e), F.lit(0.0)) for e in exposures))
    ends = raw.agg(F.min("_raw").alias("_low"), F.max("_raw").alias("_high"))
    penalty = F.coalesce(ratio(most * (F.col("_raw") - F.col("_low")), F.col("_high") - F.col("_low")), F.lit(0.0))
    both = raw.crossJoin(F.broadcast(ends))  # one row of bounds
    return both.withColumn("penalty", penalty).withColumn("neutral", clip(F.col(score) - strength * F.col("penalty"), 0.0, 100.0)).drop("_raw", "_low", "_high")


def capped_in_order(weights: DataFrame, group: str, caps: dict[str, float]) -> DataFrame:
    """Group caps in the given order: what a group has above its cap goes to all others pro rata, so a later cap sees what
    earlier ones handed on. All members of a group move by one factor, so only totals by capped group are folded."""
    w = F.greatest(F.col("weight"), F.lit(0.0))
    names = list(caps)
    at = F.coalesce(*[F.when(F.col(group) == n, i) for i, n in enumerate(names)], F.lit(len(names)))
    own = weights.withColumns({"_w": w, "_at": at})
    totals = own.agg(F.sum("_w").alias("_all"), F.array(*[F.coalesce(F.sum(F.when(F.col("_at") == i, F.col("_w"))), F.lit(0.0)) for i in range(len(names) + 1)]).alias("_sums"))
    before = totals.select("_all", F.transform("_sums", lambda s: s / F.col("_all")).alias("_before"))
    after = F.col("_before")
    for i, n in enumerate(names):
        after = _handed_on(after, i, caps[n])
    both = own.crossJoin(F.broadcast(before.select("_all", "_before", after.alias("_after"))))  # one row of totals
    factor = ratio(F.get("_after", F.col("_at")), F.get("_before", F.col("_at")))
    total = F.aggregate("_after", F.lit(0.0), lambda a, v: a + v)
    return both.withColumn("capped", F.coalesce(F.col("_w") / F.col("_all") * factor / total, F.lit(0.0))).drop("_w", "_at", "_all", "_before", "_after")


def _handed_on(sums: Column, i: int, cap: float) -> Column:
    """Totals after group i gave what is above its cap to the others."""

    def step(state: Column) -> Column:
        own = F.get(state, F.lit(i))
        rest = F.aggregate(state, F.lit(0.0), lambda a, v: a + v) - own
        over = F.greatest(own - cap, F.lit(0.0))
        return F.transform(state, lambda v, j: F.when(j == i, v - over).otherwise(F.when(rest > 0, v + v / rest * over).otherwise(v)))

    return F.get(F.transform(F.array(sums), step), F.lit(0))


def pair_attribution(pnl: DataFrame, key: str = "pair") -> DataFrame:
    """(key, dt, pnl): each member's pnl, its share of the total, and mean over sd of its daily pnl."""
    daily = pnl.groupBy(key, "dt").agg(F.sum("pnl").alias("pnl"))
    per = daily.groupBy(key).agg(F.sum("pnl").alias("pnl"), ratio(F.avg("pnl"), F.stddev_samp("pnl")).alias("info_ratio"))
    total = per.agg(F.sum("pnl").alias("_all"))
    return per.crossJoin(F.broadcast(total)).withColumn("share", ratio("pnl", "_all")).drop("_all")  # one row of totals


def drawdown_stress(pnl: DataFrame, key: str = "pair") -> DataFrame:
    """Mean correlation of members' daily pnl between peak and trough of the worst drawdown, over pairs of members with at
    least three common days. One equi-join on the day."""
    inside = pnl.join(F.broadcast(worst_window(pnl)), (F.col("dt") > F.col("peak_dt")) & (F.col("dt") <= F.col("trough_dt")))
    daily = inside.groupBy(key, "dt").agg(F.sum("pnl").alias("pnl"))
    a, b = daily.select(F.col(key).alias("a"), "dt", F.col("pnl").alias("x")), daily.select(F.col(key).alias("b"), "dt", F.col("pnl").alias("y"))
    pairs = a.join(b, "dt").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), correlation("x", "y").alias("corr")).where("n >= 3")
    return pairs.agg(F.count("corr").alias("n_links"), F.avg("corr").alias("mean_corr"))


def portfolio_risk(weights: DataFrame, returns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Volatility, parametric value at risk and worst drawdown of the weighted sum of returns, one row a date."""
    daily = returns.join(weights.select("symbol", "weight"), "symbol").groupBy("dt").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    o = Window.partitionBy(F.lit(0)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    path = daily.withColumn("cum", F.sum("r").over(o)).withColumn("dd", F.col("cum") - F.greatest(F.max("cum").over(o), F.lit(0.0)))
    z = NormalDist().inv_cdf(confidence)
    return path.agg(F.count("*").alias("n"), F.stddev_samp("r").alias("vol"), (z * F.stddev_samp("r") - F.avg("r")).alias("value_at_risk"), F.min("dd").alias("max_drawdown"), F.sum("r").alias("total"))


def market_regimes(factors: DataFrame) -> DataFrame:
    """One of six labels of each row's (risk, growth, inflation); the order of the rules is their meaning."""
    r, g, i = F.col("risk"), F.col("growth"), F.col("inflation")
    label = F.when((r < -0.5) | ((g < -0.4) & (i < 0)), "risk_off").when((i > 0.4) & (g < 0), "stagflation").when((i > 0) & (g > 0.2), "reflation").when((g < -0.2) & (r <= 0.2), "slowdown").when(r > 0, "risk_on").otherwise("neutral")
    return factors.withColumn("regime", label)


def block_permutation(df: DataFrame, r: str, key: str, replicates: int, block: int, at: str = "dt", seed: int = 42) -> DataFrame:
    """Is the mean of sign(last return) x return due to the order of returns? Blocks of observed returns are put in random
    order; p is the share of orders at least as good, no less than one over their number. Inner products of a block don't
    change, so an order is made of (inner sum, first, last) of blocks only: replicates x blocks rows, not x returns. Orders
    are hashes of (seed, key, replicate, block), so that a task run again draws the same."""
    rows = df.where(F.col(r).isNotNull()).select(key, at, F.col(r).alias("r"), F.floor((F.row_number().over(ordered(key, at)) - 1) / block).cast("int").alias("blk"))
    inner = Window.partitionBy(key, "blk").orderBy(at)
    per = rows.withColumn("gain", F.signum(F.lag("r").over(inner)) * F.col("r")).groupBy(key, "blk").agg(F.count("*").alias("m"), F.coalesce(F.sum("gain"), F.lit(0.0)).alias("inner"), F.min_by("r", at).alias("first"), F.max_by("r", at).alias("last"))
    draw = F.when(F.col("rep") == 0, F.lpad(F.col("blk").cast("string"), 12, "0")).otherwise(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key), F.col("rep").cast("string"), F.col("blk").cast("string"))))
    orders = per.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("draw", draw)  # 0: as observed
    joint = F.signum(F.lag("last").over(Window.partitionBy(key, "rep").orderBy("draw"))) * F.col("first")
    stats = orders.withColumn("joint", joint).groupBy(key, "rep").agg(F.sum("m").alias("n"), ratio(F.sum("inner") + F.coalesce(F.sum("joint"), F.lit(0.0)), F.sum("m") - 1).alias("stat"))
    seen = F.max(F.when(F.col("rep") == 0, F.col("stat"))).over(Window.partitionBy(key))
    reached = stats.withColumn("observed", seen).where("rep > 0").groupBy(key).agg(F.max("n").alias("n"), F.max("observed").alias("observed"), F.avg((F.col("stat") >= F.col("observed") - 1e-12).cast("double")).alias("share"))
    return reached.select(key, "n", "observed", F.greatest("share", F.lit(1 / replicates)).alias("p"))


def standardised(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """(id, k, v): z of each metric over all rows; moments come from one aggregate."""
    long = df.select(F.col(key).alias("id"), F.inline(F.array(*[F.struct(F.lit(m).alias("k"), F.col(m).cast("double").alias("v")) for m in metrics])))
    moments = long.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))  # one row a metric
    return long.join(F.broadcast(moments), "k").select("id", "k", ratio(F.col("v") - F.col("m"), "s").alias("v"))


def aligned_with(df: DataFrame, key: str, metrics: Sequence[str], benchmark: str) -> DataFrame:
    """Cosine of every profile with a benchmark profile, and what each metric adds to it (they sum to the cosine)."""
    z = standardised(df, key, metrics)
    base = z.where(F.col("id") == benchmark).select("k", F.col("v").alias("b"))  # one row a metric
    j = z.where(F.col("id") != benchmark).join(F.broadcast(base), "k")
    own = Window.partitionBy("id")
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(own))
    parts = j.select("id", F.col("k").alias("metric"), ratio(F.col("v") * F.col("b"), length("v") * length("b")).alias("contribution"))
    return parts.withColumn("cosine", F.sum("contribution").over(own))


def rolling_map(df: DataFrame, key: str, value: str, n: int, f: Callable[[np.ndarray], np.ndarray], at: str = "dt") -> DataFrame:
    """(key, at, result): f of every full trailing window of a series; null before. f takes the windows as rows of a matrix
    and gives one number a row; a group is one series."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at)
        out = np.full(len(rows), np.nan)
        if len(rows) >= n:
            out[n - 1 :] = f(np.lib.stride_tricks.sliding_window_view(rows[value].to_numpy(float), n))
        return pd.DataFrame({key: rows[key], at: rows[at], "result": pd.Series(out, rows.index).astype(object).where(~np.isnan(out), None)})

    kept = df.select(key, at, value)
    types = dict(kept.dtypes)
    return kept.groupBy(key).applyInPandas(run, f"{key} {types[key]}, {at} {types[at]}, result double")


def dataset(features: DataFrame, labels: DataFrame, keys: Sequence[str], label: str, train_end: str, test_start: str) -> DataFrame:
    """Features with their label on (key, date); rows without a label go, and so do rows between the end of training and the
    start of the test. Tagged train or test."""
    part = F.when(F.col("dt") <= F.lit(train_end).cast("date"), "train").when(F.col("dt") >= F.lit(test_start).cast("date"), "test")
    return features.join(labels.select(*keys, label), list(keys)).where(F.col(label).isNotNull()).withColumn("part", part).where("part IS NOT NULL")


def leakage_checks(df: DataFrame, features: Sequence[str], train_end: str, tolerance: float = 0.01) -> DataFrame:
    """Per fold of a tagged dataset: training rows after the declared end, and whether means and deviations of all features
    in training and test lie so near that both seem to be scaled together."""
    mine = lambda p, c: F.when(F.col("part") == p, F.col(c))
    late = F.count_if((F.col("part") == "train") & (F.col("dt") > F.lit(train_end).cast("date")))
    near = [(F.abs(F.avg(mine("train", c)) - F.avg(mine("test", c))) <= tolerance * F.stddev_samp(mine("train", c))) & (F.abs(F.stddev_samp(mine("test", c)) - F.stddev_samp(mine("train", c))) <= tolerance * F.stddev_samp(mine("train", c))) for c in features]
    both = near[0]
    for x in near[1:]:
        both = both & x
    return df.groupBy("fold").agg(late.alias("rows_after_end"), F.coalesce(both, F.lit(False)).alias("scaled_together"))


def field_coverage(df: DataFrame, key: str, required: Sequence[str], at: str = "dt") -> DataFrame:
    """Per key: span of dates, rows, share of missing values of the required fields, and required fields that the table
    lacks, which count as missing."""
    have = [c for c in required if c in df.columns]
    gaps = sum((F.col(c).isNull().cast("int") for c in have), F.lit(len(required) - len(have)))
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.array(*map(F.lit, df.columns))))
    g = df.groupBy(key).agg(F.min(at).alias("first_dt"), F.max(at).alias("last_dt"), F.count("*").alias("n"), F.avg(gaps / len(required)).alias("missing_share"))
    return g.withColumn("lacking", F.concat_ws(",", lacking))


def tightened_limits(state: DataFrame, daily_loss: float, leverage: float, least_loss: float = 0.005, least_leverage: float = 0.5) -> DataFrame:
    """Daily loss and gross leverage limits of rows with vix, regime and breaches: tightened by regime, by the level of the
    VIX, and by the number of recent breaches, never below their floors."""
    # Factors of loss and leverage by regime and by VIX.
    regime, vix, b = F.col("regime"), F.col("vix"), F.col("breaches")
    by_regime = lambda crisis, off, on: F.when(regime == "crisis", crisis).when(regime == "risk_off", off).when(regime == "risk_on", on).otherwise(1.0)
    by_vix = lambda high, raised: F.when(vix >= 40, high).when(vix >= 25, raised).otherwise(1.0)
    broken = F.when(b > 0, F.greatest(F.lit(0.4), 1 - 0.1 * b)).otherwise(1.0)
    loss = F.greatest(F.lit(least_loss), daily_loss * by_regime(0.5, 0.7, 1.1) * by_vix(0.6, 0.8) * broken)
    gross = F.greatest(F.lit(least_leverage), leverage * by_regime(0.5, 0.7, 1.1) * by_vix(0.5, 0.8) * broken)
    return state.withColumns({"max_daily_loss": loss, "max_leverage": gross})


def limits_what_if(daily: DataFrame, key: str, value: str, sets: dict[str, float]) -> DataFrame:
    """How many rows of each key fall below minus the limit, and whether any does, under each named limit, in one pass."""
    long = daily.select(key, F.col(value).alias("v"), F.inline(F.array(*[F.struct(F.lit(n).alias("limits"), F.lit(x).alias("bound")) for n, x in sets.items()])))
    return long.groupBy(key, "limits").agg(F.count_if(F.col("v") < -F.col("bound")).alias("n_breaches"), F.max(F.coalesce(F.col("v") < -F.col("bound"), F.lit(False))).alias("would_stop"), F.min("v").alias("worst"))


def score_momentum(df: DataFrame, score: str, key: str = "symbol", at: str = "dt", days: int = 90) -> DataFrame:
    """Change against the last score at least so many days before, and deviation and count of scores within them."""
    o = Window.partitionBy(key).orderBy("_day")
    d = df.select(key, at, F.col(score).alias("score"), F.datediff(at, F.lit("1970-01-01").cast("date")).alias("_day"))
    before = F.last("score", True).over(o.rangeBetween(Window.unboundedPreceding, -days))
    inside = o.rangeBetween(1 - days, 0)
    return d.select(key, at, "score", (F.col("score") - before).alias("momentum"), F.stddev_samp("score").over(inside).alias("deviation"), F.count("score").over(inside).alias("n"))


def spread_state(spread: DataFrame, key: str = "pair_id", x: str = "spread", at: str = "dt", short: int = 12, long: int = 36) -> DataFrame:
    """Latest volatility of changes over two frames, the deviation of the short one over the long frame, and the share of
    all |deviations from the mean so far| that the last one reaches."""
    o = ordered(key, at)
    frame = lambda n: o.rowsBetween(1 - n, 0)
    d = spread.select(key, at, F.abs(F.col(x) - F.avg(x).over(so_far(key, at))).alias("gap"), (F.col(x) - F.lag(x).over(o)).alias("chg"))
    v = d.withColumns({"vol_short": F.stddev_samp("chg").over(frame(short)), "vol_long": F.stddev_samp("chg").over(frame(long))})
    v = v.withColumns({"vol_of_vol": F.stddev_samp("vol_short").over(frame(long)), "last_gap": F.max_by("gap", at).over(Window.partitionBy(key))})
    now = F.max_by(F.struct("vol_short", "vol_long", "vol_of_vol"), at)
    g = v.groupBy(key).agg(F.count("*").alias("n"), now.alias("s"), (100 * F.avg((F.col("gap") <= F.col("last_gap")).cast("double"))).alias("gap_percentile"))
    return g.select(key, "n", "s.*", "gap_percentile")
