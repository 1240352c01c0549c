"""Grouped summaries: bars, coverage, trade KPIs, exposure, distributions. Partial aggregation happens before each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import ratio, slope, so_far


def resampled(df: DataFrame, grain: str, key: str = "symbol", at: str = "dt") -> DataFrame:
    """OHLCV per coarser period."""
    return df.groupBy(key, F.date_trunc(grain, at).cast("date").alias("period")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume")
    )


def on_calendar(df: DataFrame, step: str, key: str = "symbol", at: str = "period") -> DataFrame:
    """Every period between a series' first and last, missing ones with nulls: each series makes its own calendar."""
    span = df.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    days = span.select(key, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias(at))
    return days.join(df, [key, at], "left")


def coverage(df: DataFrame, key: str = "symbol", at: str = "dt") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(at).alias("first_dt"), F.max(at).alias("last_dt"))


def trial_summary(trials: DataFrame) -> DataFrame:
    """Per pair: trials, complete ones, studies, best, median and tails."""
    q = F.percentile("score", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = trials.groupBy("pair").agg(F.count("*").alias("n_trials"), F.count_if(F.col("state") == "COMPLETE").alias("n_complete"), F.countDistinct("study_id").alias("n_studies"), F.max("study_id").alias("last_study"), F.max("score").alias("best"), q.alias("q"))
    return out.select("*", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90")).drop("q")


def trade_kpis(trades: DataFrame, keys: list[str], pnl: str = "pnl") -> DataFrame:
    """n, total, mean, sd, win rate, mean win and loss, payoff, expectancy, profit factor, tail ratio, Sharpe by sqrt(n)."""
    p = F.col(pnl)
    win, loss = F.avg(F.when(p > 0, p)), F.avg(F.when(p < 0, p))
    rate = F.avg((p > 0).cast("double"))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(p).alias("total"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("sd"), rate.alias("win_rate"), win.alias("avg_win"), loss.alias("avg_loss"), F.abs(ratio(win, loss)).alias("payoff"),
        (rate * F.coalesce(win, F.lit(0.0)) + (1 - rate) * F.coalesce(loss, F.lit(0.0))).alias("expectancy"), F.abs(ratio(F.sum(F.when(p > 0, p)), F.sum(F.when(p < 0, p)))).alias("profit_factor"),
        ratio(F.percentile(p, 0.95), F.abs(F.percentile(p, 0.05))).alias("tail_ratio"), (ratio(F.avg(p), F.stddev_samp(p)) * F.sqrt(F.count("*"))).alias("sharpe_n"),
    )


#: Bounds of holding times in days.
DURATIONS = (1, 3, 7, 14, 30, 60, 90, 180, 365)


def duration_bin(days: Column) -> Column:
    out = F.when(days < DURATIONS[0], f"<{DURATIONS[0]}")
    for lo, hi in zip(DURATIONS, DURATIONS[1:]):
        out = out.when(days < hi, f"{lo}-{hi}")
    return out.otherwise(f">={DURATIONS[-1]}")


def calendar_pnl(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.year("entry").alias("year"), F.month("entry").alias("month"), "side").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))


def legs(positions: DataFrame) -> DataFrame:
    """One row a leg."""
    leg = lambda s: F.struct(F.lit(s).alias("leg"), F.col(f"leg_{s}").alias("symbol"), F.col(f"notional_{s}").alias("notional"))
    return positions.select("pair", "strategy", F.inline(F.array(leg("x"), leg("y"))))


def exposure(legs_: DataFrame, levels: list[str], equity: float) -> DataFrame:
    """Gross, long, short, net and share of equity at every level, from one scan by grouping sets."""
    n = F.col("notional")
    sums = [F.sum(F.abs(n)).alias("gross"), F.sum(F.greatest(n, F.lit(0.0))).alias("long"), F.sum(F.least(n, F.lit(0.0))).alias("short"), F.sum(n).alias("net"), F.countDistinct("pair").alias("n_pairs"), F.count("*").alias("n_legs")]
    out = legs_.groupingSets([[c] for c in levels], *levels).agg(*sums, F.grouping_id().alias("_g"))
    name = F.coalesce(*[F.when(F.col("_g").bitwiseAND(1 << (len(levels) - 1 - k)) == 0, F.lit(c)) for k, c in enumerate(levels)])
    value = F.coalesce(*[F.col(c).cast("string") for c in levels])
    return out.select(name.alias("level"), value.alias("name"), "gross", "long", "short", "net", "n_pairs", "n_legs", (F.col("gross") / equity).alias("gross_pct"))


def concentration(legs_: DataFrame, min_pairs: int, min_share: float) -> DataFrame:
    """Per instrument: pairs, net, share of gross, and whether it dominates."""
    per = legs_.groupBy("symbol").agg(F.countDistinct("pair").alias("n_pairs"), F.sum("notional").alias("net"), F.sum(F.abs("notional")).alias("gross"))
    total = legs_.agg(F.sum(F.abs("notional")).alias("all_gross"))
    return per.join(F.broadcast(total)).select("symbol", "n_pairs", "net", "gross", (F.col("gross") / F.col("all_gross")).alias("share"), ((F.col("n_pairs") >= min_pairs) | (F.col("gross") / F.col("all_gross") >= min_share)).alias("dominant"))


def bucket_risk(df: DataFrame, bucket: str, pnl: str, at: str, per_year: int = 252) -> DataFrame:
    """Total, annual sd, worst drawdown of cumulated pnl, Sharpe, worst day, and share of the summed volatility."""
    daily = df.groupBy(bucket, at).agg(F.sum(pnl).alias("pnl")).withColumn("cum", F.sum("pnl").over(so_far(bucket, at)))
    path = daily.withColumn("dd", F.col("cum") - F.max("cum").over(so_far(bucket, at)))
    out = path.groupBy(bucket).agg(F.sum("pnl").alias("total"), (F.stddev_samp("pnl") * per_year**0.5).alias("vol"), F.min("dd").alias("max_drawdown"), (ratio(F.avg("pnl"), F.stddev_samp("pnl")) * per_year**0.5).alias("sharpe"), F.min("pnl").alias("worst"), F.count("*").alias("n"))
    return out.withColumn("contribution", ratio("vol", F.sum("vol").over(Window.partitionBy())))  # one row a bucket


def by_regime(df: DataFrame, keys: list[str], r: str, least: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.percentile(r, 0.5).alias("median"), F.stddev_samp(r).alias("sd"), F.avg((F.col(r) > 0).cast("double")).alias("hit"), ratio(F.avg(r), F.stddev_samp(r)).alias("sharpe")).where(F.col("n") >= least)


def sensitivity(df: DataFrame, params: list[str], score: str, bins: int) -> DataFrame:
    """Per parameter: median score of equal-width bins (the last closed), all parameters in one pass."""
    long = df.select(F.col(score).alias("score"), F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params])))
    bounds = long.groupBy("param").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    k = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins))
    return long.join(F.broadcast(bounds), "param").where("hi > lo").groupBy("param", k.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.percentile("score", 0.5).alias("median_score"))


def sensitivity_slope(binned: DataFrame) -> DataFrame:
    return binned.groupBy("param").agg(slope("median_score", "bin").alias("slope"), F.count("*").alias("n_bins"))


def param_stability(df: DataFrame, params: list[str]) -> DataFrame:
    """sd / |mean| of each parameter, and max(0, 1 - it)."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params])))
    return long.groupBy("param").agg(ratio(F.stddev_samp("value"), F.abs(F.avg("value"))).alias("cv")).withColumn("stability", F.greatest(F.lit(0.0), 1 - F.col("cv")))
