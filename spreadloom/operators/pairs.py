"""Operators on pairs of series. A pair is a row of a join keyed (pair_id, dt); the reference thresholds are defaults.

All pairs come from one self join on the date with symbol order as the residual: equi on dt, never a cross join of
series. Every statistic is one aggregate on pair_id, with partial sums before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import correlation, ordered, ratio, slope, so_far, trailing, whole


def aligned(series: DataFrame, pairs: DataFrame, value: str = "close") -> DataFrame:
    """(sym_x, sym_y, pair_id, dt, x, y) of listed pairs on their common dates. The leg order is kept as given."""
    x = series.select(F.col("symbol").alias("sym_x"), "dt", F.col(value).alias("x")).where("x IS NOT NULL")
    y = series.select(F.col("symbol").alias("sym_y"), "dt", F.col(value).alias("y")).where("y IS NOT NULL")
    return pairs.select("sym_x", "sym_y").join(x, "sym_x").join(y, ["sym_y", "dt"]).select("sym_x", "sym_y", F.concat_ws("/", "sym_x", "sym_y").alias("pair_id"), "dt", "x", "y")


def all_pairs(series: DataFrame, value: str = "close") -> DataFrame:
    """Every unordered pair of symbols on its common dates, once."""
    x = series.select(F.col("symbol").alias("sym_x"), "dt", F.col(value).alias("x")).where("x IS NOT NULL")
    y = series.select(F.col("symbol").alias("sym_y"), "dt", F.col(value).alias("y")).where("y IS NOT NULL")
    return x.join(y, "dt").where("sym_x < sym_y").select("sym_x", "sym_y", F.concat_ws("/", "sym_x", "sym_y").alias("pair_id"), "dt", "x", "y")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Left rows with the right value at the latest time at or before theirs: one union and one window, no range join."""
    tagged = right.select(key, at, F.lit(0).alias("_side"), F.col(value).alias("_v"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in (key, at)])
    both = tagged.unionByName(left.select(*left.columns, F.lit(1).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", True).over(w)).where("_side = 1").select(*left.columns, value)


def in_folds(df: DataFrame, folds: DataFrame, at: str = "dt") -> DataFrame:
    """Rows tagged train or test by each fold's bounds (fold, train_start, train_end, test_start, test_end); a row may be
    in many folds. The fold table is a few rows."""
    hit = F.col(at).between(F.col("train_start"), F.col("train_end")) | F.col(at).between(F.col("test_start"), F.col("test_end"))
    part = F.when(F.col(at).between(F.col("train_start"), F.col("train_end")), "train").otherwise("test")
    return df.join(folds, hit).select(*df.columns, "fold", part.alias("part"))


def pair_correlation(pairs: DataFrame, low: float = 0.5, high: float = 0.995, max_vol_ratio: float = 5.0, least: int = 2) -> DataFrame:
    """Correlation of returns, overlap, ratio of volatilities, and whether the pair is a candidate."""
    w = ordered("pair_id")
    r = pairs.select("pair_id", "sym_x", "sym_y", (F.ln("x") - F.lag(F.ln("x")).over(w)).alias("rx"), (F.ln("y") - F.lag(F.ln("y")).over(w)).alias("ry"))
    out = r.groupBy("pair_id", "sym_x", "sym_y").agg(F.count("rx").alias("n"), correlation("rx", "ry").alias("corr"), ratio(F.greatest(F.stddev_samp("rx"), F.stddev_samp("ry")), F.least(F.stddev_samp("rx"), F.stddev_samp("ry"))).alias("vol_ratio"))
    return out.withColumn("is_candidate", F.coalesce((F.col("n") >= least) & F.abs("corr").between(low, high) & (F.col("vol_ratio") <= max_vol_ratio), F.lit(False)))


def rank_correlation(pairs: DataFrame) -> DataFrame:
    """Spearman: ranks with ties averaged, then Pearson."""
    rank = lambda c: F.rank().over(Window.partitionBy("pair_id").orderBy(c)) + (F.count("*").over(Window.partitionBy("pair_id", c)) - 1) / 2
    return pairs.select("pair_id", rank("x").alias("rx"), rank("y").alias("ry")).groupBy("pair_id").agg(F.count("*").alias("n"), correlation("rx", "ry").alias("spearman"))


def price_distance(pairs: DataFrame) -> DataFrame:
    """Mean squared difference of prices over their first, and max(0, 1 - it)."""
    w = so_far("pair_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    norm = pairs.select("pair_id", (F.col("x") / F.first("x").over(w) - F.col("y") / F.first("y").over(w)).alias("d"))
    return norm.groupBy("pair_id").agg(F.avg(F.col("d") * F.col("d")).alias("ssd")).withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("ssd")))


def static_hedge(pairs: DataFrame, until: Column | None = None, floor: float = 1e-8) -> DataFrame:
    """log x = a + b log y by least squares on dates up to ``until``; mean and sd of the residual from the same moments."""
    lx, ly = F.ln(F.greatest("x", F.lit(floor))), F.ln(F.greatest("y", F.lit(floor)))
    rows = pairs if until is None else pairs.where(until)
    m = rows.select("pair_id", lx.alias("lx"), ly.alias("ly")).groupBy("pair_id").agg(
        F.count("*").alias("n"), F.avg("lx").alias("mx"), F.avg("ly").alias("my"), F.var_samp("lx").alias("vx"), F.var_samp("ly").alias("vy"), F.covar_samp("lx", "ly").alias("cxy")
    )
    b = ratio("cxy", "vy")
    out = m.withColumn("beta", b).withColumn("intercept", F.col("mx") - F.col("beta") * F.col("my"))
    left = F.greatest(F.col("vx") - F.col("beta") * F.col("cxy"), F.lit(0.0))
    tls = ratio(F.col("vx") - F.col("vy") + F.sqrt(F.pow(F.col("vx") - F.col("vy"), 2) + 4 * F.col("cxy") * F.col("cxy")), 2 * F.col("cxy"))
    return out.select("pair_id", "n", "beta", "intercept", F.sqrt(left).alias("resid_sd"), ratio(F.col("beta") * F.col("cxy"), "vx").alias("r2"), tls.alias("tls_beta"))


def spread(pairs: DataFrame, hedge: DataFrame) -> DataFrame:
    """log x - intercept - beta log y on every date."""
    return pairs.join(hedge.select("pair_id", "beta", "intercept"), "pair_id").withColumn("spread", F.ln("x") - F.col("intercept") - F.col("beta") * F.ln("y"))


def half_life(df: DataFrame, s: str = "spread", key: str = "pair_id", least: int = 20) -> DataFrame:
    """AR(1): kappa is the slope of the change on the level before; -ln 2 / kappa, infinite if kappa >= 0."""
    before = F.lag(s).over(ordered(key))
    k = df.select(key, before.alias("b"), (F.col(s) - before).alias("d")).groupBy(key).agg(F.count("d").alias("n"), slope("d", "b").alias("kappa"))
    return k.withColumn("half_life", F.when(F.col("n") + 1 < least, None).when(F.col("kappa") >= 0, float("inf")).otherwise(ratio(F.lit(-math.log(2)), "kappa")))


def dickey_fuller(df: DataFrame, s: str = "spread", key: str = "pair_id") -> DataFrame:
    """t statistic of the level before in a regression of the change on it with a constant (no lags), in closed form."""
    before = F.lag(s).over(ordered(key))
    m = df.select(key, before.alias("b"), (F.col(s) - before).alias("d")).where("d IS NOT NULL").groupBy(key).agg(F.count("*").alias("n"), F.var_pop("b").alias("vb"), F.var_pop("d").alias("vd"), F.covar_pop("b", "d").alias("c"))
    g = ratio("c", "vb")
    sse = F.col("n") * (F.col("vd") - g * F.col("c"))
    return m.select(key, "n", g.alias("gamma"), ratio(g, F.sqrt(ratio(ratio(sse, F.col("n") - 2), F.col("n") * F.col("vb")))).alias("adf_t"))


def variance_ratio(df: DataFrame, s: str = "spread", k: int = 5, key: str = "pair_id") -> DataFrame:
    """VR(k) with divisor n, and its z robust to changing variance."""
    w = ordered(key)
    d = df.select(key, "dt", (F.col(s) - F.lag(s).over(w)).alias("d1"), (F.col(s) - F.lag(s, k).over(w)).alias("dk"))
    mu = F.avg("d1").over(whole(key))
    e = d.select(key, "dt", (F.col("d1") - mu).alias("e"), (F.col("dk") - k * mu).alias("ek"))
    lags = e.select("*", *[(F.lag("e", j).over(w)).alias(f"e{j}") for j in range(1, k)])
    sq = F.col("e") * F.col("e")
    agg = lags.groupBy(key).agg(F.count("e").alias("n"), F.sum(sq).alias("s1"), F.sum(F.col("ek") * F.col("ek")).alias("sk"), *[F.sum(sq * F.col(f"e{j}") * F.col(f"e{j}")).alias(f"c{j}") for j in range(1, k)])
    vr = ratio(F.col("sk") / k, "s1")
    theta = sum((2.0 * (k - j) / k) ** 2 * ratio(F.col(f"c{j}"), F.col("s1") * F.col("s1")) for j in range(1, k))
    return agg.select(key, "n", vr.alias("vr"), ratio(vr - 1, F.sqrt(theta)).alias("vr_z"))


def hedge_stability(pairs: DataFrame, windows: int = 8, length: int = 60) -> DataFrame:
    """1 - sd / |mean| of the hedge ratios of equally spaced windows."""
    n = F.count("*").over(whole("pair_id"))
    rows = pairs.select("pair_id", F.ln("x").alias("lx"), F.ln("y").alias("ly"), (F.row_number().over(ordered("pair_id")) - 1).alias("rn"), n.alias("n"))
    step = F.floor((F.col("n") - length) / (windows - 1))
    tagged = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))).where((F.col("rn") >= F.col("k") * step) & (F.col("rn") < F.col("k") * step + length))
    betas = tagged.groupBy("pair_id", "k").agg(slope("lx", "ly").alias("beta"))
    return betas.groupBy("pair_id").agg(F.greatest(F.lit(0.0), 1 - ratio(F.stddev_pop("beta"), F.abs(F.avg("beta")))).alias("stability"))


def correlation_snapshot(pairs: DataFrame, horizons: tuple[int, ...] = (21, 63, 126)) -> DataFrame:
    """Correlation of returns over the last h rows of each horizon, and over all."""
    w = ordered("pair_id")
    r = pairs.select("pair_id", (F.ln("x") - F.lag(F.ln("x")).over(w)).alias("rx"), (F.ln("y") - F.lag(F.ln("y")).over(w)).alias("ry"), F.row_number().over(Window.partitionBy("pair_id").orderBy(F.col("dt").desc())).alias("age"))
    last = lambda c, h: F.when(F.col("age") <= h, F.col(c))
    out = r.groupBy("pair_id").agg(*[correlation(last("rx", h), last("ry", h)).alias(f"corr_{h}") for h in horizons], correlation("rx", "ry").alias("corr_all"))
    return out.withColumn("trend", F.when(F.col(f"corr_{horizons[0]}") > F.col("corr_all") + 0.1, "rising").when(F.col(f"corr_{horizons[0]}") < F.col("corr_all") - 0.1, "falling").otherwise("stable"))


def tail_dependence(pairs: DataFrame, u: float = 0.9) -> DataFrame:
    """P(y > q_u | x > q_u) and its mirror below the 1 - u quantiles."""
    w = whole("pair_id")
    q = lambda c, p: F.percentile(c, p).over(w)
    t = pairs.select("pair_id", (F.col("x") > q("x", u)).alias("xu"), (F.col("y") > q("y", u)).alias("yu"), (F.col("x") < q("x", 1 - u)).alias("xl"), (F.col("y") < q("y", 1 - u)).alias("yl"))
    share = lambda a, b: ratio(F.count_if(F.col(a) & F.col(b)).cast("double"), F.count_if(a).cast("double"))
    return t.groupBy("pair_id").agg(share("xu", "yu").alias("upper"), share("xl", "yl").alias("lower"))


def shrunk_covariance(pairs: DataFrame, series: DataFrame, value: str, shrink: float = 0.1) -> DataFrame:
    """Pairwise sample covariances; off the diagonal times 1 - shrink."""
    own = series.groupBy("symbol").agg(F.var_samp(value).alias("cov")).select(F.col("symbol").alias("sym_x"), F.col("symbol").alias("sym_y"), "cov")
    off = pairs.groupBy("sym_x", "sym_y").agg((F.covar_samp("x", "y") * (1 - shrink)).alias("cov"))
    return own.unionByName(off)


def effective_bets(corr: DataFrame, n: int | Column) -> DataFrame:
    """n^2 / sum of squared correlations over the whole matrix (the diagonal counts n)."""
    return corr.agg((F.max("n_symbols") * F.max("n_symbols") / (F.max("n_symbols") + 2 * F.sum(F.col("corr") * F.col("corr")))).alias("effective_bets"))


def degree(corr: DataFrame, threshold: float) -> DataFrame:
    """Number of partners with |corr| at the threshold or above."""
    edges = corr.where(F.abs("corr") >= threshold).select(F.explode(F.array("sym_x", "sym_y")).alias("symbol"))
    return edges.groupBy("symbol").agg(F.count("*").alias("degree"))


def pair_metrics(pairs: DataFrame, per_year: int = 52) -> DataFrame:
    """One row a pair: correlation of returns, hedge, half-life, and performance of the spread's changes."""
    hedge = static_hedge(pairs)
    s = spread(pairs, hedge)
    w = ordered("pair_id")
    d = s.withColumn("chg", F.col("spread") - F.lag("spread").over(w)).withColumn("dd", F.col("spread") - F.max("spread").over(so_far("pair_id")))
    perf = d.groupBy("pair_id").agg(
        ratio(F.avg("chg"), F.stddev_samp("chg")).alias("sr"), ratio(F.avg("chg"), F.sqrt(F.avg(F.pow(F.least("chg", F.lit(0.0)), 2)))).alias("so"), F.stddev_samp("chg").alias("spread_vol"), F.min("dd").alias("spread_max_dd"),
        F.avg((F.col("chg") > 0).cast("double")).alias("spread_pos_ratio"), F.avg((F.col("chg") < 0).cast("double")).alias("spread_neg_ratio"),
    )
    scale = math.sqrt(per_year)
    return (
        pair_correlation(pairs).select("pair_id", "sym_x", "sym_y", "corr").join(hedge.select("pair_id", F.col("n").alias("n_obs"), "beta", "intercept"), "pair_id").join(half_life(s).select("pair_id", "half_life"), "pair_id").join(perf, "pair_id")
        .select("pair_id", "sym_x", "sym_y", "n_obs", "corr", "beta", "intercept", "half_life", (F.col("sr") * scale).alias("spread_sharpe"), (F.col("so") * scale).alias("spread_sortino"), "spread_vol", "spread_max_dd", "spread_pos_ratio", "spread_neg_ratio")
    )


def is_viable(least_n: int = 252, low: float = 2.0, high: float = 120.0, max_corr: float = 0.999, min_vol: float = 1e-8, min_sharpe: float = 0.0) -> Column:
    return F.coalesce((F.col("n_obs") >= least_n) & F.col("half_life").between(low, high) & (F.col("corr") < max_corr) & (F.col("spread_vol") > min_vol) & (F.col("spread_sharpe") >= min_sharpe), F.lit(False))


def pair_score(df: DataFrame) -> DataFrame:
    """Score parts and their sum, its label, the clone mark, and the rank."""
    c = F.col
    parts = df.select(
        "*", F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.coalesce(c("spread_sharpe"), F.lit(0.0)))).alias("risk_return_score"),
        (F.coalesce(F.abs("corr"), F.lit(0.0)) + F.when(c("half_life").between(2, 120), 0.5).otherwise(0.0)).alias("stats_quality_score"), F.when(c("n_obs") < 50, 0.5).otherwise(0.0).alias("penalty_total"),
    )
    total = parts.withColumn("pair_score", c("risk_return_score") + c("stats_quality_score") - c("penalty_total"))
    return total.withColumn("is_clone_like", F.coalesce((c("corr") >= 0.995) & (F.abs("spread_sharpe") <= 0.1), F.lit(False)))


def rolling_health(pairs: DataFrame, short: int = 21, long: int = 63) -> DataFrame:
    """Short rolling correlation of levels as a z against its own longer frame."""
    w, v = trailing(short, "pair_id"), trailing(long, "pair_id")
    c = pairs.withColumn("corr_s", F.when(F.count("*").over(w) == short, correlation("x", "y", w)))
    return c.withColumn("corr_z", F.when(F.count("corr_s").over(v) == long, ratio(F.col("corr_s") - F.avg("corr_s").over(v), F.stddev_pop("corr_s").over(v))))


def day_overlap(series: DataFrame, pairs: DataFrame) -> DataFrame:
    """Days of both legs, of either, and of one alone, per pair: exploded legs, no product of day sets."""
    legs = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("x").alias("leg"), F.col("sym_x").alias("symbol")), F.struct(F.lit("y").alias("leg"), F.col("sym_y").alias("symbol")))).alias("l")).select("pair_id", "l.*")
    days = legs.join(series.select("symbol", "dt"), "symbol").groupBy("pair_id", "dt").agg(F.count_if(F.col("leg") == "x").alias("hx"), F.count_if(F.col("leg") == "y").alias("hy"))
    both = F.count_if((F.col("hx") > 0) & (F.col("hy") > 0))
    return days.groupBy("pair_id").agg(both.alias("n_both"), F.count("*").alias("n_any"), (F.count("*") - both).alias("n_one"), (both / F.count("*")).alias("overlap"))


def factor_links(spreads: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """(pair_id, factor, n, corr, beta) of changes of a spread against changes of each factor on the same dates. Changes of
    the factors, one series, are taken once; the join is on the date."""
    o = Window.orderBy("dt")  # one series of dates
    moves = factors.select("dt", *[(F.col(c) - F.lag(c).over(o)).alias(c) for c in names])
    long = moves.unpivot("dt", names, "factor", "move").where("move IS NOT NULL")
    d = spreads.select("pair_id", "dt", (F.col("spread") - F.lag("spread").over(ordered("pair_id"))).alias("d")).where("d IS NOT NULL")
    return d.join(long, "dt").groupBy("pair_id", "factor").agg(F.count("*").alias("n"), correlation("d", "move").alias("corr"), slope("d", "move").alias("beta"))


def pair_quality(overlaps: DataFrame, correlations: DataFrame, legs: DataFrame, least_overlap: float = 0.5, least_corr: float = 0.2) -> DataFrame:
    """(pair_id, overlap, corr, n_warnings, status) from day overlaps, correlations and the status of both legs."""
    of = lambda side: legs.select(F.col("symbol").alias(f"sym_{side}"), F.col("status").alias(f"status_{side}"))
    j = correlations.join(overlaps, "pair_id", "left").join(of("x"), "sym_x", "left").join(of("y"), "sym_y", "left")
    rules = [F.coalesce("overlap", F.lit(0.0)) < least_overlap, F.coalesce(F.abs("corr"), F.lit(0.0)) < least_corr, F.coalesce("status_x", F.lit("bad")) == "bad", F.coalesce("status_y", F.lit("bad")) == "bad"]
    n = sum(r.cast("int") for r in rules)
    return j.select("pair_id", "overlap", "corr", n.alias("n_warnings"), F.when(n == 0, "ok").when(n == 1, "warn").otherwise("bad").alias("status"))
