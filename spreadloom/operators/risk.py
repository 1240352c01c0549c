"""Risk and performance measures over return, weight and position tables; one row a book, all books at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import correlation, ordered, ratio, slope, so_far


def value_at_risk(df: DataFrame, r: str, key: str, level: float = 0.95, z: float = 1.6448536269514722) -> DataFrame:
    """Historical, parametric and Cornish-Fisher VaR, and the mean beyond the historical quantile. z: normal quantile."""
    w = Window.partitionBy(key)
    tail = df.select(key, F.col(r).alias("r"), F.percentile(r, 1 - level).over(w).alias("q"))
    s, k = F.skewness("r"), F.kurtosis("r")
    cf = -z + (z * z - 1) * s / 6 + (-(z**3) + 3 * z) * k / 24 - (-2 * z**3 + 5 * z) * s * s / 36
    return tail.groupBy(key).agg(
        F.count("r").alias("n"), F.first("q").alias("var_hist"), (F.avg("r") - z * F.stddev_samp("r")).alias("var_param"), (F.avg("r") + cf * F.stddev_samp("r")).alias("var_cf"), F.avg(F.when(F.col("r") <= F.col("q"), F.col("r"))).alias("es")
    )


def tail_risk(df: DataFrame, r: str, key: str, at: str = "dt") -> DataFrame:
    """Skewness, kurtosis, Jarque-Bera, omega, gain to pain, worst row and worst five rows together."""
    five = F.sum(r).over(ordered(key, at).rowsBetween(-4, 0))
    full5 = F.when(F.count(r).over(ordered(key, at).rowsBetween(-4, 0)) == 5, five)
    d = df.select(key, F.col(r).alias("r"), full5.alias("five"))
    n, s, k = F.count("r"), F.skewness("r"), F.kurtosis("r")
    loss = F.abs(F.sum(F.least("r", F.lit(0.0))))
    return d.groupBy(key).agg(s.alias("skew"), k.alias("kurt"), (n / 6 * (s * s + k * k / 4)).alias("jarque_bera"), ratio(F.sum(F.greatest("r", F.lit(0.0))), loss).alias("omega"), ratio(F.sum("r"), loss).alias("gain_pain"), F.min("r").alias("worst"), F.min("five").alias("worst_five"))


def against_benchmark(df: DataFrame, r: str, bench: str, key: str, per_year: int = 252) -> DataFrame:
    """Beta, alpha, R2, tracking error, information ratio, hit rate and captures."""
    a, b = F.col(r), F.col(bench)
    beta = slope(r, bench)
    te = F.stddev_samp(a - b)
    return df.where(a.isNotNull() & b.isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), beta.alias("beta"), ((F.avg(a) - beta * F.avg(b)) * per_year).alias("alpha"), F.pow(correlation(r, bench), 2).alias("r2"), (te * math.sqrt(per_year)).alias("tracking_error"), (ratio(F.avg(a - b), te) * math.sqrt(per_year)).alias("info_ratio"),
        F.avg((a > b).cast("double")).alias("hit_rate"), ratio(F.avg(F.when(b > 0, a)), F.avg(F.when(b > 0, b))).alias("up_capture"), ratio(F.avg(F.when(b < 0, a)), F.avg(F.when(b < 0, b))).alias("down_capture"),
    )


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """w_i (Cov w)_i over the portfolio's volatility, from a long covariance table (sym_x, sym_y, cov), both triangles."""
    w_j = weights.select(F.col("symbol").alias("sym_y"), F.col("weight").alias("w_j"))
    m = cov.join(w_j, "sym_y").groupBy("sym_x").agg(F.sum(F.col("cov") * F.col("w_j")).alias("cw")).withColumnRenamed("sym_x", "symbol")
    part = weights.join(m, "symbol").withColumn("part", F.col("weight") * F.col("cw"))
    total = part.agg(F.sqrt(F.sum("part")).alias("vol"))
    return part.join(F.broadcast(total)).select("symbol", "weight", (F.col("part") / F.col("vol")).alias("contribution"), (F.col("cw") / F.col("vol")).alias("marginal"))


def both_triangles(cov: DataFrame) -> DataFrame:
    return cov.union(cov.where("sym_x <> sym_y").select(F.col("sym_y").alias("sym_x"), F.col("sym_x").alias("sym_y"), "cov"))


def inverse_vol_weights(df: DataFrame, r: str, key: str, cap: float) -> DataFrame:
    """1 / volatility, normalised, clipped at the cap and normalised once more."""
    v = df.groupBy(key).agg(F.stddev_samp(r).alias("vol")).where("vol > 0")
    w = Window.partitionBy()  # one row a symbol
    raw = v.withColumn("raw", 1 / F.col("vol") / F.sum(1 / F.col("vol")).over(w)).withColumn("cut", F.least("raw", F.lit(cap)))
    return raw.select(key, "vol", (F.col("cut") / F.sum("cut").over(w)).alias("weight"))


def group_capped(weights: DataFrame, group: str, cap: float) -> DataFrame:
    """Groups over the cap are scaled down to it; then all is normalised."""
    g = F.sum("weight").over(Window.partitionBy(group))
    cut = weights.withColumn("cut", F.col("weight") * F.least(F.lit(1.0), cap / g))
    return cut.withColumn("capped", F.col("cut") / F.sum("cut").over(Window.partitionBy())).drop("cut")


def rebalance(current: DataFrame, target: DataFrame, capital: float, drift: float, bps: float = 3.0) -> DataFrame:
    """Trades from current (symbol, notional) to target (symbol, weight), where the drift is at least the threshold."""
    both = current.join(target, "symbol", "full_outer").select("symbol", F.coalesce("notional", F.lit(0.0)).alias("now"), (F.coalesce("weight", F.lit(0.0)) * capital).alias("want"))
    d = F.col("want") - F.col("now")
    return both.select("symbol", "now", "want", F.when(F.abs(d) / capital >= drift, d).otherwise(0.0).alias("trade")).withColumn("cost", F.abs("trade") * bps / 1e4)


def heat_levels(daily: DataFrame, key: str, at: str = "dt", equity: str = "equity") -> DataFrame:
    """Ordered levels from drawdown, change over 30 rows, and the run of losing rows."""
    o = ordered(key, at)
    d = daily.withColumn("drawdown", F.col(equity) / F.max(equity).over(so_far(key, at)) - 1).withColumn("chg", F.col(equity) - F.lag(equity).over(o)).withColumn("rn", F.row_number().over(o))
    d = d.withColumn("streak", F.col("rn") - F.coalesce(F.last(F.when(~F.coalesce(F.col("chg") < 0, F.lit(False)), F.col("rn")), True).over(so_far(key, at)), F.lit(0)))
    dd, r30 = F.col("drawdown"), F.col(equity) / F.lag(equity, 30).over(o) - 1
    d = d.withColumn("roll30", r30)
    level = F.when(dd <= -0.2, "HALTED").when(dd <= -0.15, "RECOVERY_ONLY").when((dd <= -0.1) | (F.col("roll30") <= -0.08), "DEFENSIVE").when((dd <= -0.07) | (F.col("streak") >= 5), "THROTTLED").when(dd <= -0.04, "CAUTIOUS").otherwise("NORMAL")
    return d.select(key, at, "drawdown", "roll30", "streak", level.alias("level"))


def shock_grid(exposures: DataFrame, shocks: DataFrame, limit: float) -> DataFrame:
    """Every exposure row under every shock of a small table (name, factor): loss and breach."""
    return exposures.join(F.broadcast(shocks)).select("name", "shock", (F.col("net") * F.col("factor")).alias("pnl"), (F.col("net") * F.col("factor") < -limit).alias("breach"))


def stress_table(df: DataFrame, r: str, key: str) -> DataFrame:
    """Named stresses from observed returns, in closed form."""
    s, m = F.stddev_samp(r), F.avg(r)
    worst = F.aggregate(F.slice(F.array_sort(F.collect_list(r)), 1, 5), F.lit(0.0), lambda a, b: a + b)
    agg = df.groupBy(key).agg(s.alias("s"), m.alias("m"), worst.alias("w"))
    rows = {"two_sigma": -2 * F.col("s"), "three_sigma": -3 * F.col("s"), "five_worst": F.col("w"), "vol_doubling": -4 * F.col("s"), "drift_20": 20 * F.col("m")}
    return agg.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("stress"), v.alias("loss")) for k, v in rows.items()])))


def performance(df: DataFrame, r: str, key: str, at: str = "dt", per_year: int = 252) -> DataFrame:
    """Sharpe, Sortino, maximum drawdown, Calmar, ulcer index, Kelly."""
    eq = df.where(F.col(r).isNotNull()).select(key, at, F.col(r).alias("r")).withColumn("eq", F.exp(F.sum(F.log1p("r")).over(so_far(key, at))))
    path = eq.withColumn("dd", F.col("eq") / F.greatest(F.max("eq").over(so_far(key, at)), F.lit(1.0)) - 1)
    y = math.sqrt(per_year)
    out = path.groupBy(key).agg(
        F.count("r").alias("n"), (ratio(F.avg("r"), F.stddev_samp("r")) * y).alias("sharpe"), (ratio(F.avg("r"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)))) * y).alias("sortino"), F.min("dd").alias("max_drawdown"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"),
        ratio(F.avg("r"), F.var_samp("r")).alias("kelly"), (F.avg("r") * per_year).alias("ann_return"),
    )
    return out.withColumn("calmar", ratio("ann_return", F.abs("max_drawdown")))


def limit_breaches(values: DataFrame, limits: DataFrame) -> DataFrame:
    """(name, metric, value) against (metric, warn, hard): rows over a limit, with severity."""
    return values.join(F.broadcast(limits), "metric").where(F.abs("value") > F.col("warn")).select("name", "metric", "value", F.when(F.abs("value") > F.col("hard"), "HARD").otherwise("WARN").alias("severity"))


def unpivoted(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("name"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def score_column(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are present."""
    total = sum(F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values())
    return ratio(sum(F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()), total)


def weight_schemes(stats: DataFrame, target_vol: float, power: float = 1.0, key: str = "symbol") -> DataFrame:
    """Weights of rows (key, vol, score): equal, by inverse volatility, by score (negative scores count nothing), by
    conviction (score over volatility), and equal ones scaled to a target volatility of uncorrelated series. Totals are one
    aggregate, given back to the rows."""
    good = F.greatest(F.col("score"), F.lit(0.0))
    parts = {"inverse_vol": 1 / F.col("vol"), "score_tilt": F.pow(good, power), "conviction": good / F.col("vol")}
    own = stats.where("vol > 0 AND score IS NOT NULL").select(key, "vol", *[v.alias(n) for n, v in parts.items()])
    totals = own.agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("vol") ** 2)).alias("all_vol"), *[F.sum(n).alias(f"all_{n}") for n in parts])
    both = own.crossJoin(F.broadcast(totals))  # one row of totals
    return both.select(key, (1 / F.col("n")).alias("equal"), *[ratio(n, f"all_{n}").alias(n) for n in parts], (F.lit(target_vol) / F.col("all_vol")).alias("vol_target"))
