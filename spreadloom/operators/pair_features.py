"""Point-in-time features and forward labels of pairs, for every (pair, date) at once.

A panel has pair_id, dt, the prices x and y, the volumes vx and vy, and z of the spread. All frames of a pair share one
shuffle and one sort. A feature is null until its frame is full; a label until enough rows follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from spreadloom.functions.columns import correlation, full, ordered, ratio, slope, so_far, trailing

KEY = "pair_id"
YEAR = 252**0.5


def returns(panel: DataFrame) -> DataFrame:
    """The panel with log returns, and the values before that several features need."""
    o = ordered(KEY)
    return panel.withColumns(
        {"rx": F.ln(ratio("x", F.lag("x").over(o))), "ry": F.ln(ratio("y", F.lag("y").over(o))), "b": F.lag("z").over(o), "dz": F.col("z") - F.lag("z").over(o)}
    )


def _sd(c: str, n: int) -> Column:
    w = trailing(n, KEY)
    return full(F.stddev_samp(c).over(w), c, w, n)


def _corr(n: int) -> Column:
    w = trailing(n, KEY)
    return full(correlation("rx", "ry", w), "rx", w, n)


def _ar1(n: int) -> Column:
    w = trailing(n, KEY)
    return full(slope("z", "b", w), "b", w, n)


def _place(n: int) -> Column:
    w = trailing(n, KEY)
    return full(ratio(F.col("z") - F.avg("z").over(w), F.stddev_samp("z").over(w)), "z", w, n)


def half_life(ar1: Column) -> Column:
    return F.when((ar1 > 0) & (ar1 < 1), F.lit(-0.6931471805599453) / F.ln(ar1))  # minus the log of 2


def pair_features(panel: DataFrame, entry: float = 2.0) -> DataFrame:
    """The z family, correlation, hedge ratio and its stability, half-life, and spread volatility."""
    o, w20, w60 = ordered(KEY), trailing(20, KEY), trailing(60, KEY)
    up = (F.abs("z") >= entry) & (F.abs("b") < entry)
    base = returns(panel).withColumns({"crossed": (F.signum("z") != F.signum("b")).cast("int"), "up": up.cast("int"), "beta20": full(slope("y", "x", w20), "x", w20, 20)})
    hedges = F.array(*[F.lag("beta20", 5 * k).over(o) for k in range(9)])
    mean = F.aggregate(hedges, F.lit(0.0), lambda s, v: s + v / 9)
    spread = F.sqrt(F.aggregate(hedges, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean) / 9))
    ar60 = _ar1(59)
    features = {
        "z_abs": F.abs("z"),
        "z_mean_20": full(F.avg("z").over(w20), "z", w20, 20),
        "z_std_20": _sd("z", 20),
        "z_mom_5": F.col("z") - F.lag("z", 5).over(o),
        "z_mom_20": F.col("z") - F.lag("z", 20).over(o),
        "z_ar1": _ar1(21),
        "z_cross_zero_20": full(F.sum("crossed").over(trailing(19, KEY)) / 20, "crossed", trailing(19, KEY), 19),
        "bb_pos_20": _place(20),
        "bb_pos_60": _place(60),
        "div_speed": (F.col("z") - F.lag("z", 3).over(o)) / 3,
        "entry_attempts_5": full(F.sum("up").over(trailing(5, KEY)), "up", trailing(5, KEY), 5).cast("double"),
        "residual_skew": full(F.skewness("z").over(w20), "z", w20, 20),
        "residual_kurt": full(F.kurtosis("z").over(w20), "z", w20, 20),
        # The reference takes log returns of z, which aren't defined for z <= 0; differences are.
        "rel_momentum": ratio(F.col("z") - F.lag("z", 20).over(o), _sd("dz", 20)),
        "corr_20": _corr(20),
        "corr_60": _corr(60),
        "corr_trend": _corr(20) - _corr(60),
        "hedge_ratio": full(slope("y", "x", w60), "x", w60, 60),
        "hr_stability": full(ratio(spread, F.abs(mean)), "x", w60, 60),
        "half_life": half_life(ar60),
        "half_life_ratio": half_life(ar60) / 30,
        "spread_vol_20": full(F.stddev_pop("dz").over(w20), "dz", w20, 20),
        "spread_vol_ratio": full(ratio(F.stddev_pop("dz").over(w20), F.stddev_pop("dz").over(w60)), "dz", w60, 60),
    }
    return base.select(KEY, "dt", "z", *[v.alias(k) for k, v in features.items()])


def cusum_range(values: Column, scale: float) -> Column:
    """Range of the running sums of an array's deviations from its mean, over its sd and ``scale``; 0 if it is constant."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
    sd = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"))

    def step(acc: Column, v: Column) -> Column:
        s = acc["s"] + v - mean
        return F.struct(s.alias("s"), F.greatest(acc["hi"], s).alias("hi"), F.least(acc["lo"], s).alias("lo"))

    return F.when(sd < 1e-12, 0.0).otherwise(F.aggregate(values, start, step, lambda a: a["hi"] - a["lo"]) / (sd * scale))


def regime_features(panel: DataFrame) -> DataFrame:
    """Volatility regime, volatility of volatility of the last rows, trend, mean reversion, persistence, break, stress and
    liquidity."""
    w20, w59, w60 = trailing(20, KEY), trailing(59, KEY), trailing(60, KEY)
    base = returns(panel).withColumns({"place": F.row_number().over(ordered(KEY)).cast("double"), "vol_x": _sd("rx", 20) * YEAR})
    w40 = trailing(40, KEY)
    trend = ratio(slope("z", "place", w20), F.stddev_pop("z").over(w20))
    features = {
        "vol_regime": ratio(_sd("rx", 20) + _sd("ry", 20), _sd("rx", 120) + _sd("ry", 120)),
        "vol_of_vol": full(F.stddev_pop("vol_x").over(w40), "vol_x", w40, 40),
        "trend_slope": full(F.coalesce(trend, F.lit(0.0)), "z", w20, 20),
        "mean_reversion_quality": _ar1(60),
        "spread_persistence": full(correlation("z", "b", w59), "b", w60, 60),
        "break_indicator": full(cusum_range(F.collect_list("z").over(w60), 60**0.5), "z", w60, 60),
        "market_stress": F.abs(_sd("rx", 20) - _sd("ry", 20)) * YEAR,
        "liquidity_proxy": full(
            ratio(F.avg("vx").over(trailing(5, KEY)) + F.avg("vy").over(trailing(5, KEY)), F.avg("vx").over(w60) + F.avg("vy").over(w60)), "vx", trailing(5, KEY), 5
        ),
    }
    return base.select(KEY, "dt", *[v.alias(k) for k, v in features.items()])


def signal_features(panel: DataFrame, entry: float = 2.0, horizon: int = 5) -> DataFrame:
    """Of every row since the first entry (|z| reaches the threshold from below) of its pair, what is known of the last
    entry: z then, days since, days since the row before z last changed sign, rows from the entry on that stay beyond the
    threshold, whether one of the five entries before it lost within ``horizon`` rows that had passed by then, the share
    of the last 60 |z| below it, and the acceleration over its last five rows."""
    o, w60 = ordered(KEY), trailing(60, KEY)
    now = so_far(KEY)
    base = panel.withColumns({"b": F.lag("z").over(o), "before": F.lag("dt").over(o), "place": F.row_number().over(o), "ahead": F.lead("z", horizon).over(o)})
    base = base.withColumns(
        {
            "entry": (F.abs("z") >= entry) & (F.abs("b") < entry),
            "cross": F.when(F.signum("z") != F.signum("b"), F.col("before")),
            "jerk": ((F.col("z") - F.col("b")) - (F.lag("z", 3).over(o) - F.lag("z", 4).over(o))) / 3,
            "gain": F.signum("z") * (F.col("z") - F.col("ahead")),
            "history": full(F.collect_list(F.abs("z")).over(w60), "z", w60, 60),
        }
    )
    mark = lambda c: F.last(F.when(F.col("entry"), F.col(c)), True).over(now)
    # Entries are at least two rows apart, so of the entries before one at most (horizon - 1) / 2 have not passed by then.
    back = [F.expr(f"lag(IF(entry, struct(place, gain), NULL), {k}) IGNORE NULLS OVER (PARTITION BY {KEY} ORDER BY dt)") for k in range(1, 6 + (horizon - 1) // 2)]
    known = F.filter(F.array(*back), lambda e: e["place"] + horizon <= F.col("place"))
    tagged = base.withColumns({"entry_z": mark("z"), "entry_dt": mark("dt"), "entry_jerk": mark("jerk"), "last_cross": F.last("cross", True).over(now), "turn": F.sum(F.col("entry").cast("int")).over(now)})
    tagged = tagged.withColumn("failed", F.when(F.col("entry"), F.exists(F.slice(known, 1, 5), lambda e: F.coalesce(e["gain"] < 0, F.lit(False))).cast("int")))
    turn = so_far((KEY, "turn"))
    features = {
        "z_at_entry": F.col("entry_z"),
        "days_since_breach": F.datediff("dt", "entry_dt").cast("long"),
        "days_since_cross": F.datediff("dt", "last_cross").cast("long"),
        "confirmation_bars": F.sum((F.abs("z") >= entry).cast("int")).over(turn).cast("long"),
        "prior_failed": F.last("failed", True).over(now).cast("long"),
        "entry_percentile": F.size(F.filter("history", lambda v: v < F.abs("entry_z"))) / 60,
        "entry_acceleration": F.col("entry_jerk"),
    }
    features["entry_percentile"] = F.when(F.col("history").isNotNull(), features["entry_percentile"])
    return tagged.where("turn > 0").select(KEY, "dt", *[v.alias(k) for k, v in features.items()])


def ahead(n: int) -> WindowSpec:
    """The next n rows."""
    return ordered(KEY).rowsBetween(1, n)


def trade_labels(panel: DataFrame, horizon: int = 10, entry: float = 2.0, cost: float = 0.003, adverse: float = 1.5, delay: int = 2, stop: float = 3.5, longest: int = 60) -> DataFrame:
    """Where |z| >= entry: target hit (four fifths of the way), profit net of cost, path without a deep adverse move,
    delayed entry better, full size (profit and path), and rows to the stop (at most ``longest``)."""
    o, f = ordered(KEY), ahead(horizon)
    s = F.signum("z")
    later = lambda k: F.lead("z", k).over(o)
    nearest = F.when(F.col("z") > 0, F.min("z").over(f)).otherwise(-F.max("z").over(f))
    farthest = F.when(F.col("z") > 0, F.max("z").over(f)).otherwise(-F.min("z").over(f)) - F.abs("z")
    side = F.transform(F.collect_list("z").over(ahead(longest)), lambda v: v * s >= stop)
    at = F.array_position(side, True)
    full_path = F.count("z").over(f) == horizon
    labels = {
        "profit_target": F.when(full_path, (nearest <= 0.2 * F.abs("z")).cast("int")),
        "profitable_net": (s * (F.col("z") - later(horizon)) > cost).cast("int"),
        "path_quality": F.when(full_path, (F.greatest(farthest, F.lit(0.0)) < adverse).cast("int")),
        "delay_better": (s * (later(delay) - later(delay + horizon)) > s * (F.col("z") - later(horizon))).cast("int"),
        "bars_to_stop": F.when(at > 0, at).otherwise(F.lit(longest)).cast("int"),
    }
    labels["size_full"] = F.when(labels["profitable_net"].isNotNull() & labels["path_quality"].isNotNull(), labels["profitable_net"] * labels["path_quality"])
    return panel.select(KEY, "dt", *[F.when(F.abs("z") >= entry, v).alias(k) for k, v in labels.items()])


def relationship_labels(panel: DataFrame, horizon: int = 30, critical: float = -2.57, break_at: float = 3.0) -> DataFrame:
    """Whether over the next rows the Dickey-Fuller statistic of the last 60 rows stays below its 10 % value, its share of
    such rows (strength), whether the half-life stays within twice and the hedge ratio within 30 % of what they are, and
    whether the spread breaks (largest running sum of deviations, over sd and the root of its length)."""
    w = trailing(60, KEY)
    f = ahead(horizon)
    base = returns(panel).withColumns({"hedge": full(slope("y", "x", w), "x", w, 60), "rho": _ar1(60), "r": full(correlation("z", "b", w), "b", w, 60), "sz": F.stddev_samp("z").over(w), "sb": F.stddev_samp("b").over(w)})
    se = ratio("sz", "sb") * F.sqrt((1 - F.col("r") * F.col("r")) / 58)
    base = base.withColumns({"df": ratio(F.col("rho") - 1, se), "hl": half_life(F.col("rho"))})
    enough = F.count("dt").over(f) == horizon
    stays = F.max("df").over(f) < critical
    moved = F.greatest(F.max("hedge").over(f) - F.col("hedge"), F.col("hedge") - F.min("hedge").over(f)) / F.abs("hedge")
    path = F.collect_list("z").over(f)
    mean = F.aggregate(path, F.lit(0.0), lambda t, v: t + v) / horizon
    sd = F.sqrt(F.aggregate(path, F.lit(0.0), lambda t, v: t + (v - mean) * (v - mean)) / horizon)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("far"))

    def step(acc: Column, v: Column) -> Column:
        s = acc["s"] + v - mean
        return F.struct(s.alias("s"), F.greatest(acc["far"], F.abs(s)).alias("far"))

    broken = F.aggregate(path, start, step, lambda a: a["far"]) / (F.when(sd > 1e-10, sd).otherwise(1.0) * horizon**0.5) > break_at
    labels = {
        "persistent": stays.cast("int"),
        "strength": F.avg((F.col("df") < critical).cast("double")).over(f),
        "half_life_stable": F.when(F.col("hl") > 0, (F.max("hl").over(f) <= 2 * F.col("hl")).cast("int")),
        "hedge_unstable": (moved > 0.3).cast("int"),
        "broken": F.when(F.count("z").over(f) == horizon, broken.cast("int")),
    }
    return base.select(KEY, "dt", *[F.when(enough, v).alias(k) for k, v in labels.items()])


def instrument_features(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Log returns over 1, 5 and 20 rows, annual volatility of 20 and 60, their ratio, momentum over volatility, the range
    of five closes over their mean, and recent over usual volume."""
    o = ordered(key)
    base = bars.withColumn("r", F.ln(ratio("close", F.lag("close").over(o))))
    w5, w20 = trailing(5, key), trailing(20, key)
    gone = lambda k: F.ln(ratio("close", F.lag("close", k).over(o)))
    vol = lambda k: full(F.stddev_samp("r").over(trailing(k, key)), "r", trailing(k, key), k) * YEAR
    features = {
        "ret_1d": F.col("r"), "ret_5d": gone(5), "ret_20d": gone(20), "vol_20d": vol(20), "vol_60d": vol(60), "vol_ratio": ratio(vol(20), vol(60)),
        "mom_20d": ratio(gone(20), vol(20)), "mom_60d": ratio(gone(60), vol(60)), "gap_5d": full(ratio(F.max("close").over(w5) - F.min("close").over(w5), F.avg("close").over(w5)), "close", w5, 5),
        "volume_ratio": full(ratio(F.avg("volume").over(w5), F.avg("volume").over(w20)), "volume", w20, 20),
    }
    return base.select(key, "dt", *[v.alias(k) for k, v in features.items()])
