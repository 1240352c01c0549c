"""Rolling and ordered operators on long panels (symbol, dt, value). Operators that share a key and an order run in one
shuffle and one sort; a frame gives null until it is full.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import clip, correlation, full, ordered, ratio, slope, so_far, trailing, whole, zscore
from spreadloom.operators.order_statistics import rolling_order


def rolling_moments(df: DataFrame, x: str, n: int, key: str = "symbol") -> DataFrame:
    """Mean, sd and variance (population), bias-corrected skewness and excess kurtosis of the last n rows."""
    w = trailing(n, key)
    m, sd = F.avg(x).over(w), F.stddev_pop(x).over(w)
    g1, g2 = F.skewness(x).over(w), F.kurtosis(x).over(w)
    skew = g1 * (n * (n - 1)) ** 0.5 / (n - 2)
    kurt = ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
    ok = sd > 1e-12
    return df.select("*", *[full(v, x, w, n).alias(k) for k, v in {"mean": m, "sd": sd, "var": F.var_pop(x).over(w), "skew": F.when(ok, skew), "kurt": F.when(ok, kurt)}.items()])


def rolling_zscore(df: DataFrame, x: str, n: int, key: str = "symbol") -> DataFrame:
    """z (population sd) and the signals variant: clipped to 4 sd first, sample sd, from max(5, n/4) values on."""
    w, least = trailing(n, key), max(5, n // 4)
    m, s = F.avg(x).over(w), F.stddev_samp(x).over(w)
    clipped = df.withColumn("_x", F.when(F.count(x).over(w) >= least, F.when(s.isNull() | F.isnan(s), F.col(x)).otherwise(clip(x, m - 4 * s, m + 4 * s))).otherwise(F.col(x)))
    return clipped.select("*", zscore(x, w, n).alias("z"), zscore("_x", w, least, ddof=1).alias("z_signal")).drop("_x")


def rolling_pair(df: DataFrame, x: str, y: str, n: int, key: str = "pair_id") -> DataFrame:
    """Rolling correlation, and slope and intercept of y on x."""
    w = trailing(n, key)
    b = slope(y, x, w)
    return df.select("*", full(correlation(x, y, w), x, w, n).alias("corr"), full(b, x, w, n).alias("beta"), full(F.avg(y).over(w) - b * F.avg(x).over(w), x, w, n).alias("alpha"))


def filled(df: DataFrame, x: str, key: str = "symbol") -> DataFrame:
    """Forward and backward fill."""
    w = ordered(key)
    return df.select("*", F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ffill"), F.first(x, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("bfill"))


def returns(df: DataFrame, x: str = "close", lag: int = 1, key: str = "symbol") -> DataFrame:
    """Difference, simple and log return over ``lag`` rows."""
    before = F.lag(x, lag).over(ordered(key))
    return df.select("*", (F.col(x) - before).alias("diff"), (ratio(x, before) - 1).alias("ret"), F.ln(ratio(x, before)).alias("log_ret"))


def rsi(df: DataFrame, x: str, n: int, key: str = "symbol") -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss) over n rows; null without losses."""
    d = F.col(x) - F.lag(x).over(ordered(key))
    df, w = df.withColumn("_d", d), trailing(n, key)
    rs = ratio(F.avg(F.greatest("_d", F.lit(0.0))).over(w), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(w))
    return df.withColumn("rsi", full(100 - 100 / (1 + rs), "_d", w, n)).drop("_d")


def bollinger(df: DataFrame, x: str, n: int, k: float = 2.0, key: str = "symbol") -> DataFrame:
    w = trailing(n, key)
    m, s = full(F.avg(x).over(w), x, w, n), full(F.stddev_samp(x).over(w), x, w, n)
    out = df.select("*", m.alias("mid"), (m + k * s).alias("upper"), (m - k * s).alias("lower"))
    width = F.col("upper") - F.col("lower")
    return out.select("*", ratio(width, "mid").alias("bandwidth"), ratio(F.col(x) - F.col("lower"), width).alias("percent_b"))


def drawdown(df: DataFrame, x: str, key: str = "symbol") -> DataFrame:
    """Running peak, drawdown from it, and the number of the underwater episode (null above water)."""
    peak = F.max(x).over(so_far(key))
    out = df.withColumn("peak", peak).withColumn("drawdown", ratio(F.col(x) - F.col("peak"), "peak"))
    under = F.col("drawdown") < -1e-6
    start = under & ~F.coalesce(F.lag(under).over(ordered(key)), F.lit(False))
    return out.withColumn("episode", F.when(under, F.sum(start.cast("int")).over(so_far(key))))


def drawdown_summary(df: DataFrame, x: str, key: str = "symbol") -> DataFrame:
    """Depth, length and number of episodes per series, and the mean of the five deepest."""
    per = drawdown(df, x, key).where("episode IS NOT NULL").groupBy(key, "episode").agg(F.min("drawdown").alias("depth"), F.count("*").alias("length"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("depth", "episode")))
    return ranked.groupBy(key).agg(F.min("depth").alias("max_drawdown"), F.max("length").alias("longest"), F.count("*").alias("episodes"), F.avg(F.when(F.col("rank") <= 5, F.col("depth"))).alias("sterling_depth"))


def cusum_break(df: DataFrame, x: str, key: str = "symbol") -> DataFrame:
    """Range of the cumulative sum of standardised values over sqrt(n), against the usual bounds, and where it is largest."""
    w = whole(key)
    std = df.withColumn("_s", ratio(F.col(x) - F.avg(x).over(w), F.stddev_pop(x).over(w))).withColumn("_c", F.sum("_s").over(so_far(key)))
    stat = (F.max("_c") - F.min("_c")) / F.sqrt(F.count("_s"))
    out = std.groupBy(key).agg(F.count("_s").alias("n"), stat.alias("cusum"), F.max_by("dt", F.struct(F.abs("_c"), "dt")).alias("break_dt"))
    return out.withColumn("level", F.when(F.col("cusum") > 1.63, "1%").when(F.col("cusum") > 1.36, "5%").when(F.col("cusum") > 1.22, "10%").otherwise("none"))


def equity(df: DataFrame, pnl: str, ret: str, key: str = "symbol") -> DataFrame:
    """Running sum of pnl, and running product of 1 + return."""
    return df.select("*", F.sum(pnl).over(so_far(key)).alias("cum_pnl"), F.exp(F.sum(F.ln(1 + F.col(ret))).over(so_far(key))).alias("growth"))


def rolling_performance(df: DataFrame, r: str, n: int, key: str = "symbol", per_year: int = 252) -> DataFrame:
    """Trailing Sharpe, Sortino, tail ratio, realised volatility."""
    w = trailing(n, key)
    down = F.sqrt(F.avg(F.pow(F.least(F.col(r), F.lit(0.0)), 2)).over(w))
    parts = {
        "sharpe": ratio(F.avg(r).over(w), F.stddev_samp(r).over(w)) * per_year**0.5,
        "sortino": ratio(F.avg(r).over(w), down) * per_year**0.5,
        "vol": F.stddev_samp(r).over(w) * per_year**0.5,
        "tail_ratio": ratio(F.percentile(r, 0.95).over(w), F.abs(F.percentile(r, 0.05).over(w))),
        "clustering": F.avg(F.pow(F.col(r), 2)).over(w),
    }
    return df.select("*", *[full(v, r, w, n).alias(k) for k, v in parts.items()])


def volatility_ratio(df: DataFrame, r: str, short: int, long: int, key: str = "symbol") -> DataFrame:
    """Ratio of short to long volatility, within 0.2 and 3, and the z of the short one over the long frame."""
    a, b = trailing(short, key), trailing(long, key)
    out = df.withColumn("vol_short", full(F.stddev_samp(r).over(a), r, a, short)).withColumn("vol_long", full(F.stddev_samp(r).over(b), r, b, long))
    return out.select("*", clip(ratio("vol_short", "vol_long"), 0.2, 3.0).alias("vol_ratio"), zscore("vol_short", b, long).alias("vol_z"))


def robust_scores(df: DataFrame, x: str, n: int, key: str = "symbol", least: int = 10) -> DataFrame:
    """(x - median) / (IQR / 1.349), and (x - median) / (1.4826 * MAD)."""
    out = rolling_order(df, x, n, {"_low": 0.25, "_high": 0.75}, key)
    away, iqr, ok = F.col(x) - F.col("median"), F.col("_high") - F.col("_low"), F.col("n_frame") >= least
    scores = F.when(ok & (iqr > 0), away / (iqr / 1.349)).alias("iqr_score"), F.when(ok, ratio(away, 1.4826 * F.col("mad"))).alias("mad_score")
    return out.select(*df.columns, *scores)


def percentile_rank(df: DataFrame, x: str, n: int, key: str = "symbol") -> DataFrame:
    """Share of the frame at or below the current value, ties counted half, and the frame's 90 % quantile."""
    out = rolling_order(df, x, n, {"_q": 0.9}, key)
    rank = (F.col("below") + (F.col("same") + 1) / 2) / F.col("n_frame")
    whole_frame = F.col("n_frame") >= n
    return out.select(*df.columns, F.when(whole_frame, rank).alias("pct_rank"), F.when(whole_frame, F.col("_q")).alias("q90"))


def autocorrelation(df: DataFrame, x: str, n: int, lag: int = 1, key: str = "symbol") -> DataFrame:
    out = df.withColumn("_lag", F.lag(x, lag).over(ordered(key)))
    w = trailing(n, key)
    return out.withColumn("autocorr", full(correlation(x, "_lag", w), "_lag", w, n)).drop("_lag")


def acf(df: DataFrame, x: str, lags: int, key: str = "symbol") -> DataFrame:
    """(key, lag, acf), normalised by n and the variance; one explode of the lags, one shuffle."""
    lagged = df.select(key, F.col(x).alias("x"), F.avg(x).over(whole(key)).alias("m"), F.row_number().over(ordered(key)).alias("rn"))
    pairs = lagged.select("*", *[F.lag("x", k).over(Window.partitionBy(key).orderBy("rn")).alias(f"l{k}") for k in range(1, lags + 1)])
    c0 = F.sum(F.pow(F.col("x") - F.col("m"), 2))
    one = pairs.groupBy(key).agg(*[ratio(F.sum((F.col("x") - F.col("m")) * (F.col(f"l{k}") - F.col("m"))), c0).alias(f"a{k}") for k in range(1, lags + 1)])
    return one.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("acf")) for k in range(1, lags + 1)])))


def universe_ranks(df: DataFrame, x: str, key: list[str]) -> DataFrame:
    """Within each date: rank from the largest, percentile with ties averaged, share of others below, top fifth."""
    n = F.count(x).over(Window.partitionBy(*key))
    rank = F.rank().over(Window.partitionBy(*key).orderBy(F.col(x).desc()))
    tied = F.count("*").over(Window.partitionBy(*key, x))
    up = F.rank().over(Window.partitionBy(*key).orderBy(x)) + (tied - 1) / 2
    return df.select("*", rank.alias("rank"), (100 * up / n).alias("percentile"), ratio(n - rank, (n - 1).cast("double")).alias("pct"), (rank <= F.greatest(F.lit(1), F.ceil(n * 0.2))).alias("is_core"))


def quantile_buckets(df: DataFrame, x: str, q: int, key: list[str]) -> DataFrame:
    """Bucket 1..q by interpolated quantile edges; equal edges count once."""
    inner = F.array_distinct(F.percentile(x, F.array(*[F.lit(k / q) for k in range(q + 1)])).over(Window.partitionBy(*key)))
    out = df.withColumn("_edges", inner)
    return out.withColumn("bucket", F.greatest(F.lit(1), F.size(F.filter("_edges", lambda e: e < F.col(x))))).drop("_edges")


def since_event(df: DataFrame, z: str, bound: float, key: str = "symbol") -> DataFrame:
    """Rows since the last change of sign, and length of the current run above the bound."""
    w = ordered(key)
    rn = F.row_number().over(w)
    cross = F.signum(z) != F.signum(F.lag(z).over(w))
    out = df.select("*", rn.alias("_rn"), cross.alias("_cross"), (F.abs(z) >= bound).alias("_hot"))
    return out.select(
        *df.columns,
        (F.col("_rn") - F.last(F.when(F.col("_cross"), F.col("_rn")), True).over(so_far(key))).alias("since_cross"),
        (F.col("_rn") - F.coalesce(F.last(F.when(~F.coalesce("_hot", F.lit(False)), F.col("_rn")), True).over(so_far(key)), F.lit(0))).alias("run_above"),
    )


def cross_signals(df: DataFrame, z: str, entry: float, exit_: float, key: str = "symbol") -> DataFrame:
    """Entry where |z| crosses the bound (long below, short above), the position before, and its exit inside the band."""
    w = ordered(key)
    before = F.lag(z).over(w)
    enter = F.when((F.col(z) <= -entry) & (before > -entry), 1).when((F.col(z) >= entry) & (before < entry), -1).otherwise(0)
    out = df.withColumn("entry", enter)
    held = F.coalesce(F.last(F.nullif("entry", F.lit(0)), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("prev_pos", held).withColumn("exit", ((F.col("prev_pos") != 0) & (F.abs(z) <= exit_) & (F.abs(F.lag(z).over(w)) > exit_)).cast("int"))


def majority(df: DataFrame, votes: list[str]) -> DataFrame:
    """1 or -1 where more than half of the votes say so; long wins."""
    need = len(votes) // 2 + 1
    count = lambda v: sum(F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c in votes)
    return df.withColumn("vote", F.when(count(1) >= need, 1).when(count(-1) >= need, -1).otherwise(0))


def regime_tags(df: DataFrame, vol: str, z: str, key: str = "symbol") -> DataFrame:
    """Terciles of volatility and the state of z."""
    w = whole(key)
    low, high = F.percentile(vol, 0.33).over(w), F.percentile(vol, 0.67).over(w)
    return df.select("*", F.when(F.col(vol).isNull(), None).when(F.col(vol) <= low, "low").when(F.col(vol) <= high, "mid").otherwise("high").alias("vol_regime"), F.when(F.col(z) > 1, "over").when(F.col(z) < -1, "under").otherwise("neutral").alias("z_state"))


def net_returns(df: DataFrame, weight: str, ret: str, bps: float, key: str = "symbol") -> DataFrame:
    """weight of the row before times return, less cost on turnover, and the running product."""
    before = F.coalesce(F.lag(weight).over(ordered(key)), F.lit(0.0))
    out = df.withColumn("turnover", F.abs(F.col(weight) - before)).withColumn("net", before * F.coalesce(ret, F.lit(0.0)) - F.col("turnover") * bps / 1e4)
    return out.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("net"))).over(so_far(key))))


def true_range(df: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """ATR, and Amihud illiquidity from the first row on."""
    before = F.lag("close").over(ordered(key))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    out = df.select("*", tr.alias("_tr"), F.abs(ratio("close", before) - 1).alias("_ar"))
    w = trailing(n, key)
    return out.select("*", full(F.avg("_tr").over(w), "_tr", w, n).alias("atr"), ratio(F.avg("_ar").over(w), F.avg("volume").over(w)).alias("amihud")).drop("_tr", "_ar")


def winsorised(df: DataFrame, x: str, key: str = "symbol", k: float = 3.0, p: float = 0.05) -> DataFrame:
    """Clipped to mean +- k sd, and to the p and 1 - p quantiles."""
    w = whole(key)
    m, s = F.avg(x).over(w), F.stddev_pop(x).over(w)
    return df.select("*", clip(x, m - k * s, m + k * s).alias("by_z"), clip(x, F.percentile(x, p).over(w), F.percentile(x, 1 - p).over(w)).alias("by_quantile"))


def scaled(df: DataFrame, x: str, key: str = "symbol") -> DataFrame:
    """Min-max (constant: 0.5), robust (constant: 0), z (constant: 0)."""
    w = whole(key)
    lo, hi, sd = F.min(x).over(w), F.max(x).over(w), F.stddev_pop(x).over(w)
    iqr = F.percentile(x, 0.75).over(w) - F.percentile(x, 0.25).over(w)
    return df.select(
        "*", F.when(hi > lo, (F.col(x) - lo) / (hi - lo)).otherwise(0.5).alias("minmax"), F.when(iqr > 0, (F.col(x) - F.percentile(x, 0.5).over(w)) / iqr).otherwise(0.0).alias("robust"), F.when(sd > 1e-12, (F.col(x) - F.avg(x).over(w)) / sd).otherwise(0.0).alias("zfull")
    )


def hurst_structure(df: DataFrame, x: str, lags: range, key: str = "symbol") -> DataFrame:
    """Slope of the log sd of lagged differences on the log lag, per series."""
    diffs = df.select(key, *[(F.col(x) - F.lag(x, k).over(ordered(key))).alias(f"d{k}") for k in lags])
    sds = diffs.groupBy(key).agg(*[F.stddev_pop(f"d{k}").alias(f"s{k}") for k in lags])
    long = sds.select(key, F.inline(F.array(*[F.struct(F.ln(F.lit(float(k))).alias("lx"), F.when(F.col(f"s{k}") > 0, F.ln(f"s{k}")).alias("ly")) for k in lags])))
    return long.groupBy(key).agg(slope("ly", "lx").alias("hurst"))


def threshold_quantiles(df: DataFrame, z: str, entry: float, exit_: float, key: str = "symbol") -> DataFrame:
    """Entry and exit bounds of a series as quantiles of |z|."""
    return df.where(F.col(z).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.percentile(F.abs(z), entry).alias("entry"), F.percentile(F.abs(z), exit_).alias("exit"))


def ewma_moments(pairs: DataFrame, span: int, key: str = "pair_id") -> DataFrame:
    """(key, dt, vol_x, vol_y, cov, corr): exponentially weighted means of the squares and the product of two return
    columns rx and ry, by the recursion of ``ewma``; a pair is one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        xx, yy, xy = (v.ewm(span=span, adjust=False).mean() for v in (rows["rx"] ** 2, rows["ry"] ** 2, rows["rx"] * rows["ry"]))
        return pd.DataFrame({key: rows[key], "dt": rows["dt"], "vol_x": xx**0.5, "vol_y": yy**0.5, "cov": xy, "corr": xy / (xx * yy) ** 0.5})

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    own = pairs.where("rx IS NOT NULL AND ry IS NOT NULL").select(key, "dt", "rx", "ry")
    return own.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, dt {kinds['dt']}, vol_x double, vol_y double, cov double, corr double")


def ewma(df: DataFrame, x: str, span: int, key: str = "symbol") -> DataFrame:
    """y = a x + (1 - a) y(-1), a = 2 / (span + 1): a recursion in time, so one series is one task, all series in parallel."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        return rows.assign(ewma=rows[x].ewm(span=span, adjust=False).mean())

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(key, "dt", x).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, dt {kinds['dt']}, {x} {kinds[x]}, ewma double")
