"""Queries of the rolling and ordered operators over weekly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.operators import windows as w
from spreadloom.plans.registry import register
from spreadloom.sources import panels


def rounded(df: DataFrame, *keys: str, **values: str) -> DataFrame:
    """The keys as they are and the values to six places, named as asked."""
    return df.select(*keys, *[(F.round(c, 6) + 0.0).alias(n) for n, c in values.items()])  # no negative zeros


R6 = lambda **v: ", ".join(f"round({e}, 6) AS {n}" for n, e in v.items())
W = "(PARTITION BY symbol ORDER BY dt ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
RET = ", r AS (SELECT symbol, dt, close, volume, close / lag(close) OVER s - 1 AS ret, ln(close / lag(close) OVER s) AS log_ret, close - lag(close) OVER s AS diff FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY dt))"


@register(f"SELECT symbol, dt, CASE WHEN n = 20 THEN round(m, 3) END AS mean, CASE WHEN n = 20 THEN round(s, 3) END AS sd, CASE WHEN n = 20 THEN round(s * s, 1) END AS var, CASE WHEN n = 20 THEN round(sk, 6) END AS skew, CASE WHEN n = 20 THEN round(ku, 6) END AS kurt FROM (SELECT symbol, dt, count(close) OVER v AS n, avg(close) OVER v AS m, stddev_pop(close) OVER v AS s, skewness(close) OVER v AS sk, kurtosis(close) OVER v AS ku FROM bars WINDOW v AS {W.format(19)})")
def e01_rolling_moments(spark, d):
    m = w.rolling_moments(panels.bars(spark, d), "close", 20)
    return m.select("symbol", "dt", *[F.round(c, k).alias(c) for c, k in (("mean", 3), ("sd", 3), ("var", 1), ("skew", 6), ("kurt", 6))])


@register(f""", c AS (SELECT symbol, dt, close, CASE WHEN count(close) OVER v >= 5 AND stddev_samp(close) OVER v IS NOT NULL THEN greatest(least(close, avg(close) OVER v + 4 * stddev_samp(close) OVER v), avg(close) OVER v - 4 * stddev_samp(close) OVER v) ELSE close END AS x FROM bars WINDOW v AS {W.format(19)})
SELECT symbol, dt, round(CASE WHEN count(close) OVER v = 20 THEN (close - avg(close) OVER v) / nullif(stddev_pop(close) OVER v, 0) END, 6) AS z, round(CASE WHEN count(x) OVER v >= 5 THEN (x - avg(x) OVER v) / nullif(stddev_samp(x) OVER v, 0) END, 6) AS z_signal FROM c WINDOW v AS {W.format(19)}""")
def e02_rolling_zscore(spark, d):
    return rounded(w.rolling_zscore(panels.bars(spark, d), "close", 20), "symbol", "dt", z="z", z_signal="z_signal")


TWO = ", two AS (SELECT a.symbol || '/' || b.symbol AS pair_id, a.dt, a.close AS x, b.close AS y FROM segs a JOIN segs b ON a.dt = b.dt AND a.symbol < b.symbol)"


def segment_pairs(spark, d):
    s = panels.segment_bars(spark, d)
    a, b = s.select("dt", F.col("symbol").alias("sa"), F.col("close").alias("x")), s.select("dt", F.col("symbol").alias("sb"), F.col("close").alias("y"))
    return a.join(b, "dt").where("sa < sb").select(F.concat_ws("/", "sa", "sb").alias("pair_id"), "dt", "x", "y")


PW = "(PARTITION BY pair_id ORDER BY dt ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@register(f"{TWO} SELECT pair_id, dt, CASE WHEN n = 30 THEN round(corr(x, y) OVER v, 6) END AS corr FROM (SELECT *, count(*) OVER v AS n FROM two WINDOW v AS {PW.format(29)}) WINDOW v AS {PW.format(29)}")
def e03_rolling_correlation(spark, d):
    return rounded(w.rolling_pair(segment_pairs(spark, d), "x", "y", 30), "pair_id", "dt", corr="corr")


@register(f"{TWO} SELECT pair_id, dt, CASE WHEN n = 30 THEN round(regr_slope(y, x) OVER v, 6) END AS beta, CASE WHEN n = 30 THEN round(regr_intercept(y, x) OVER v, 4) END AS alpha FROM (SELECT *, count(*) OVER v AS n FROM two WINDOW v AS {PW.format(29)}) WINDOW v AS {PW.format(29)}")
def e04_rolling_ols(spark, d):
    return w.rolling_pair(segment_pairs(spark, d), "x", "y", 30).select("pair_id", "dt", F.round("beta", 6).alias("beta"), F.round("alpha", 4).alias("alpha"))


@register("""SELECT symbol, dt, round(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ffill,
round(first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bfill FROM (SELECT symbol, dt, CASE WHEN volume > 60 THEN close END AS x FROM bars)""")
def e05_fill(spark, d):
    b = panels.bars(spark, d).select("symbol", "dt", F.when(F.col("volume") > 60, F.col("close")).alias("x"))
    return rounded(w.filled(b, "x"), "symbol", "dt", ffill="ffill", bfill="bfill")


@register(f"{RET} SELECT symbol, dt, round(diff, 8) AS diff, {R6(ret='ret', log_ret='log_ret')} FROM r")
def e06_returns(spark, d):
    return w.returns(panels.bars(spark, d)).select("symbol", "dt", F.round("diff", 8).alias("diff"), F.round("ret", 6).alias("ret"), F.round("log_ret", 6).alias("log_ret"))


@register(f"{RET}, g AS (SELECT *, greatest(diff, 0) AS up, greatest(-diff, 0) AS down FROM r) SELECT symbol, dt, CASE WHEN count(diff) OVER v = 14 THEN round(100 - 100 / (1 + avg(up) OVER v / nullif(avg(down) OVER v, 0)), 6) END AS rsi FROM (SELECT symbol, dt, diff, CASE WHEN diff IS NULL THEN NULL ELSE up END AS up, CASE WHEN diff IS NULL THEN NULL ELSE down END AS down FROM g) WINDOW v AS {W.format(13)}")
def e07_rsi(spark, d):
    b = w.rsi(panels.bars(spark, d), "close", 14)
    return rounded(b, "symbol", "dt", rsi="rsi")


@register(f", m AS (SELECT symbol, dt, close, CASE WHEN count(close) OVER v = 20 THEN avg(close) OVER v END AS mid, stddev_samp(close) OVER v AS s FROM bars WINDOW v AS {W.format(19)}) SELECT symbol, dt, round(mid, 3) AS mid, round(mid + 2 * s, 3) AS upper, round(mid - 2 * s, 3) AS lower, {R6(bandwidth='4 * s / mid', percent_b='(close - (mid - 2 * s)) / (4 * s)')} FROM (SELECT symbol, dt, close, mid, CASE WHEN mid IS NOT NULL THEN s END AS s FROM m)")
def e08_bollinger(spark, d):
    b = w.bollinger(panels.bars(spark, d), "close", 20)
    return b.select("symbol", "dt", *[F.round(c, 3).alias(c) for c in ("mid", "upper", "lower")], F.round("bandwidth", 6).alias("bandwidth"), F.round("percent_b", 6).alias("percent_b"))


#: Weights of the recursion written out: the first value counts whole, later ones by 2 / (span + 1).
EWMA = "pow(11 / 13.0::DOUBLE, a.k - b.k) * CASE WHEN b.k = 1 THEN 1 ELSE 2 / 13.0::DOUBLE END"


@register(f""", n AS (SELECT symbol, dt, close, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS k FROM bars)
SELECT a.symbol, a.dt, round(sum(b.close * {EWMA}), 6) AS ewma FROM n a JOIN n b ON a.symbol = b.symbol AND b.k <= a.k GROUP BY 1, 2""")
def e09_ewma(spark, d):
    return rounded(w.ewma(panels.bars(spark, d), "close", 12), "symbol", "dt", ewma="ewma")


DD = """, p AS (SELECT symbol, dt, close / max(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS dd FROM bars),
u AS (SELECT *, dd < -1e-6 AS under, dd < -1e-6 AND NOT coalesce(lag(dd < -1e-6) OVER (PARTITION BY symbol ORDER BY dt), false) AS start FROM p),
e AS (SELECT symbol, dt, dd, under, sum(start::INT) OVER (PARTITION BY symbol ORDER BY dt) AS episode FROM u)"""


@register(f"{DD}, per AS (SELECT symbol, episode, min(dd) AS depth, count(*) AS length FROM e WHERE under GROUP BY 1, 2) SELECT symbol, round(min(depth), 6) AS max_drawdown, max(length) AS longest, count(*) AS episodes, round(avg(depth) FILTER (WHERE k <= 5), 6) AS sterling_depth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, episode) AS k FROM per) GROUP BY symbol")
def e10_drawdown(spark, d):
    return w.drawdown_summary(panels.bars(spark, d), "close").select("symbol", F.round("max_drawdown", 6).alias("max_drawdown"), "longest", "episodes", F.round("sterling_depth", 6).alias("sterling_depth"))


@register("""SELECT symbol, count(s) AS n, round((max(c) - min(c)) / sqrt(count(s)), 6) AS cusum, arg_max(dt, round(abs(c), 9)) AS break_dt, CASE WHEN (max(c) - min(c)) / sqrt(count(s)) > 1.63 THEN '1%' WHEN (max(c) - min(c)) / sqrt(count(s)) > 1.36 THEN '5%' WHEN (max(c) - min(c)) / sqrt(count(s)) > 1.22 THEN '10%' ELSE 'none' END AS level
FROM (SELECT *, sum(s) OVER (PARTITION BY symbol ORDER BY dt) AS c FROM (SELECT symbol, dt, (close - avg(close) OVER (PARTITION BY symbol)) / stddev_pop(close) OVER (PARTITION BY symbol) AS s FROM bars)) GROUP BY symbol""")
def e11_cusum(spark, d):
    return w.cusum_break(panels.bars(spark, d), "close").select("symbol", "n", F.round("cusum", 6).alias("cusum"), "break_dt", "level")


@register(f"""{RET} SELECT symbol, dt, {", ".join(f"CASE WHEN count(ret) OVER v = 26 THEN round({e}, 6) END AS {n}" for n, e in dict(sharpe='avg(ret) OVER v / nullif(stddev_samp(ret) OVER v, 0) * sqrt(252)', sortino='avg(ret) OVER v / nullif(sqrt(avg(least(ret, 0) ** 2) OVER v), 0) * sqrt(252)', vol='stddev_samp(ret) OVER v * sqrt(252)', tail_ratio='quantile_cont(ret, 0.95) OVER v / nullif(abs(quantile_cont(ret, 0.05) OVER v), 0)', clustering='avg(ret * ret) OVER v').items())}
FROM (SELECT symbol, dt, ret FROM r) WINDOW v AS {W.format(25)}""")
def e13_rolling_performance(spark, d):
    p = w.rolling_performance(w.returns(panels.bars(spark, d)), "ret", 26)
    return rounded(p, "symbol", "dt", **{c: c for c in ("sharpe", "sortino", "vol", "tail_ratio", "clustering")})


@register(f"""{RET}, a AS (SELECT symbol, dt, CASE WHEN count(ret) OVER s = 10 THEN stddev_samp(ret) OVER s END AS vs, CASE WHEN count(ret) OVER l = 40 THEN stddev_samp(ret) OVER l END AS vl FROM r WINDOW s AS {W.format(9)}, l AS {W.format(39)})
SELECT symbol, dt, round(CASE WHEN vs / nullif(vl, 0) IS NOT NULL THEN least(greatest(vs / vl, 0.2), 3.0) END, 6) AS vol_ratio, round(CASE WHEN count(vs) OVER l = 40 THEN (vs - avg(vs) OVER l) / nullif(stddev_pop(vs) OVER l, 0) END, 6) AS vol_z FROM a WINDOW l AS {W.format(39)}""")
def e14_volatility_ratio(spark, d):
    return rounded(w.volatility_ratio(w.returns(panels.bars(spark, d)), "ret", 10, 40), "symbol", "dt", vol_ratio="vol_ratio", vol_z="vol_z")


@register(f""", q AS (SELECT symbol, dt, close, quantile_cont(close, 0.5) OVER v AS m, quantile_cont(close, 0.75) OVER v - quantile_cont(close, 0.25) OVER v AS iqr, list(close) OVER v AS f FROM bars WINDOW v AS {W.format(29)})
SELECT symbol, dt, CASE WHEN len(f) >= 10 AND iqr > 0 THEN round((close - m) / (iqr / 1.349), 6) END AS iqr_score, CASE WHEN len(f) >= 10 THEN round((close - m) / nullif(1.4826 * list_aggregate(list_transform(f, lambda v: abs(v - m)), 'quantile_cont', 0.5), 0), 6) END AS mad_score FROM q""")
def e15_robust_scores(spark, d):
    return rounded(w.robust_scores(panels.bars(spark, d), "close", 30), "symbol", "dt", iqr_score="iqr_score", mad_score="mad_score")


@register(f""", q AS (SELECT symbol, dt, close, list(close) OVER v AS f, quantile_cont(close, 0.9) OVER v AS q FROM bars WINDOW v AS {W.format(25)})
SELECT symbol, dt, CASE WHEN len(f) = 26 THEN round((len(list_filter(f, lambda v: v < close)) + (len(list_filter(f, lambda v: v = close)) + 1) / 2.0) / 26, 6) END AS pct_rank, CASE WHEN len(f) = 26 THEN round(q, 6) END AS q90 FROM q""")
def e17_percentile_rank(spark, d):
    return rounded(w.percentile_rank(panels.bars(spark, d), "close", 26), "symbol", "dt", pct_rank="pct_rank", q90="q90")


@register(f", l AS (SELECT symbol, dt, close, lag(close) OVER (PARTITION BY symbol ORDER BY dt) AS b FROM bars) SELECT symbol, dt, CASE WHEN count(b) OVER v = 30 THEN round(corr(close, b) OVER v, 6) END AS autocorr FROM l WINDOW v AS {W.format(29)}")
def e18_autocorrelation(spark, d):
    return rounded(w.autocorrelation(panels.bars(spark, d), "close", 30), "symbol", "dt", autocorr="autocorr")


@register(", n AS (SELECT symbol, close - avg(close) OVER (PARTITION BY symbol) AS x, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS k FROM bars), v AS (SELECT symbol, sum(x * x) AS c FROM n GROUP BY 1) SELECT a.symbol, (b.k - a.k)::INT AS lag, round(sum(a.x * b.x) / max(c), 6) AS acf FROM n a JOIN n b ON a.symbol = b.symbol AND b.k BETWEEN a.k + 1 AND a.k + 6 JOIN v ON v.symbol = a.symbol GROUP BY 1, 2")
def e18_acf(spark, d):
    return rounded(w.acf(panels.bars(spark, d), "close", 6), "symbol", "lag", acf="acf")


@register(grain="month", sql=", s AS (SELECT symbol, l, stddev_pop(d) AS sd FROM (SELECT symbol, l, close - lag(close, l) OVER (PARTITION BY symbol, l ORDER BY dt) AS d FROM bars, (SELECT unnest(range(2, 20))::INT AS l)) GROUP BY 1, 2) SELECT symbol, round(regr_slope(ln(sd), ln(l)), 6) AS hurst FROM s WHERE sd > 0 GROUP BY 1")
def e21_hurst(spark, d):
    return rounded(w.hurst_structure(panels.bars(spark, d, "month"), "close", range(2, 20)), "symbol", hurst="hurst")


@register("""SELECT symbol, dt, rank() OVER (PARTITION BY dt ORDER BY volume DESC) AS rank, round(100 * (rank() OVER (PARTITION BY dt ORDER BY volume) + (count(*) OVER (PARTITION BY dt, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY dt), 6) AS percentile,
round((count(*) OVER (PARTITION BY dt) - rank() OVER (PARTITION BY dt ORDER BY volume DESC)) / nullif(count(*) OVER (PARTITION BY dt) - 1, 0)::DOUBLE, 6) AS pct, rank() OVER (PARTITION BY dt ORDER BY volume DESC) <= greatest(1, ceil(count(*) OVER (PARTITION BY dt) * 0.2)) AS is_core FROM bars""")
def e22_universe_ranks(spark, d):
    return w.universe_ranks(panels.bars(spark, d), "volume", ["dt"]).select("symbol", "dt", "rank", F.round("percentile", 6).alias("percentile"), F.round("pct", 6).alias("pct"), "is_core")


@register("""SELECT symbol, dt, greatest(1, len(list_filter(list_distinct(quantile_cont(volume, [0, 0.25, 0.5, 0.75, 1]) OVER (PARTITION BY dt)), lambda e: e < volume))) AS bucket FROM bars""")
def e23_quantile_buckets(spark, d):
    return w.quantile_buckets(panels.bars(spark, d), "volume", 4, ["dt"]).select("symbol", "dt", F.col("bucket").cast("long").alias("bucket"))


ZSQL = f", zz AS (SELECT symbol, dt, CASE WHEN count(close) OVER v = 20 THEN (close - avg(close) OVER v) / stddev_pop(close) OVER v END AS z FROM bars WINDOW v AS {W.format(19)})"


def bar_z(spark, d):
    return w.rolling_zscore(panels.bars(spark, d), "close", 20).select("symbol", "dt", "close", "z")


@register(f"""{ZSQL}, k AS (SELECT *, row_number() OVER s AS rn, sign(z) <> sign(lag(z) OVER s) AS crossed, abs(z) >= 1 AS hot FROM zz WINDOW s AS (PARTITION BY symbol ORDER BY dt))
SELECT symbol, dt, rn - last_value(CASE WHEN crossed THEN rn END IGNORE NULLS) OVER s AS since_cross, rn - coalesce(last_value(CASE WHEN NOT coalesce(hot, false) THEN rn END IGNORE NULLS) OVER s, 0) AS run_above FROM k WINDOW s AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def e24_since_event(spark, d):
    return w.since_event(bar_z(spark, d), "z", 1.0).select("symbol", "dt", F.col("since_cross").cast("long").alias("since_cross"), F.col("run_above").cast("long").alias("run_above"))


@register(f"""{ZSQL}, k AS (SELECT *, lag(z) OVER s AS b FROM zz WINDOW s AS (PARTITION BY symbol ORDER BY dt)), e AS (SELECT *, CASE WHEN z <= -1.5 AND b > -1.5 THEN 1 WHEN z >= 1.5 AND b < 1.5 THEN -1 ELSE 0 END AS entry FROM k),
h AS (SELECT *, coalesce(last_value(nullif(entry, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_pos FROM e)
SELECT symbol, dt, entry, prev_pos, (prev_pos <> 0 AND abs(z) <= 0.5 AND abs(b) > 0.5)::INT AS exit FROM h""")
def e25_cross_signals(spark, d):
    return w.cross_signals(bar_z(spark, d), "z", 1.5, 0.5).select("symbol", "dt", "entry", "prev_pos", "exit")


@register(f"""{ZSQL}, s AS (SELECT symbol, dt, CASE WHEN z < -1 THEN 1 WHEN z > 1 THEN -1 ELSE 0 END AS a, CASE WHEN z < -0.5 THEN 1 WHEN z > 0.5 THEN -1 ELSE 0 END AS b, CASE WHEN z < lag(z) OVER (PARTITION BY symbol ORDER BY dt) THEN 1 ELSE -1 END AS c FROM zz)
SELECT symbol, dt, CASE WHEN (a = 1)::INT + (b = 1)::INT + (c = 1)::INT >= 2 THEN 1 WHEN (a = -1)::INT + (b = -1)::INT + (c = -1)::INT >= 2 THEN -1 ELSE 0 END AS vote FROM s""")
def e26_majority(spark, d):
    from spreadloom.functions.columns import ordered

    z = F.col("z")
    votes = bar_z(spark, d).select("symbol", "dt", F.when(z < -1, 1).when(z > 1, -1).otherwise(0).alias("a"), F.when(z < -0.5, 1).when(z > 0.5, -1).otherwise(0).alias("b"), F.when(z < F.lag(z).over(ordered()), 1).otherwise(-1).alias("c"))
    return w.majority(votes, ["a", "b", "c"]).select("symbol", "dt", "vote")


@register(f"""{RET}, a AS (SELECT r.symbol, r.dt, CASE WHEN count(ret) OVER v = 20 THEN stddev_samp(ret) OVER v * sqrt(252) END AS vol, CASE WHEN count(close) OVER v = 20 THEN (close - avg(close) OVER v) / stddev_pop(close) OVER v END AS z FROM r WINDOW v AS {W.format(19)}),
b AS (SELECT *, quantile_cont(vol, 0.33) OVER (PARTITION BY symbol) AS lo, quantile_cont(vol, 0.67) OVER (PARTITION BY symbol) AS hi FROM a)
SELECT symbol, dt, CASE WHEN vol IS NULL THEN NULL WHEN vol <= lo THEN 'low' WHEN vol <= hi THEN 'mid' ELSE 'high' END AS vol_regime, CASE WHEN z > 1 THEN 'over' WHEN z < -1 THEN 'under' ELSE 'neutral' END AS z_state FROM b""")
def e28_regime_tags(spark, d):
    p = w.rolling_performance(w.returns(panels.bars(spark, d)), "ret", 20)
    return w.regime_tags(w.rolling_zscore(p, "close", 20), "vol", "z").select("symbol", "dt", "vol_regime", "z_state")


@register(f"""{RET}, wz AS (SELECT r.symbol, r.dt, ret, CASE WHEN z IS NULL THEN 0.0 ELSE -least(greatest(z, -1), 1) END AS wgt FROM r JOIN (SELECT symbol, dt, CASE WHEN count(close) OVER v = 20 THEN (close - avg(close) OVER v) / stddev_pop(close) OVER v END AS z FROM bars WINDOW v AS {W.format(19)}) USING (symbol, dt)),
n AS (SELECT *, coalesce(lag(wgt) OVER (PARTITION BY symbol ORDER BY dt), 0) AS b FROM wz)
SELECT symbol, dt, round(abs(wgt - b), 6) AS turnover, round(b * coalesce(ret, 0) - abs(wgt - b) * 5 / 1e4, 6) + 0.0 AS net FROM n""")
def e29_net_returns(spark, d):
    from spreadloom.functions.columns import clip

    z = w.rolling_zscore(w.returns(panels.bars(spark, d)), "close", 20)
    return rounded(w.net_returns(z.withColumn("w", F.coalesce(-clip("z", -1.0, 1.0), F.lit(0.0))), "w", "ret", 5.0), "symbol", "dt", turnover="turnover", net="net")


@register(f""", t AS (SELECT symbol, dt, volume, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr, abs(close / lag(close) OVER s - 1) AS ar FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY dt))
SELECT symbol, dt, CASE WHEN count(tr) OVER v = 14 THEN round(avg(tr) OVER v, 6) END AS atr, round(avg(ar) OVER v / nullif(avg(volume) OVER v, 0), 6) AS amihud FROM t WINDOW v AS {W.format(13)}""")
def e30_true_range(spark, d):
    return rounded(w.true_range(panels.bars(spark, d), 14), "symbol", "dt", atr="atr", amihud="amihud")


@register(f"""{TWO}, b AS (SELECT pair_id, dt, x, y, CASE WHEN count(*) OVER v = 30 THEN regr_slope(y, x) OVER v END AS beta FROM two WINDOW v AS {PW.format(29)}), s AS (SELECT *, y - beta * x AS spread, x / nullif(y, 0) AS ratio FROM b)
SELECT pair_id, dt, round(spread, 4) AS spread, round(ratio, 6) AS ratio, CASE WHEN count(spread) OVER v = 30 THEN round((spread - avg(spread) OVER v) / nullif(stddev_pop(spread) OVER v, 0), 6) END AS spread_z FROM s WINDOW v AS {PW.format(29)}""")
def e31_spread_forms(spark, d):
    from spreadloom.functions.columns import ratio, trailing, zscore

    p = w.rolling_pair(segment_pairs(spark, d), "x", "y", 30).withColumn("spread", F.col("y") - F.col("beta") * F.col("x"))
    return p.select("pair_id", "dt", F.round("spread", 4).alias("spread"), F.round(ratio("x", "y"), 6).alias("ratio"), F.round(zscore("spread", trailing(30, "pair_id"), 30), 6).alias("spread_z"))


@register("""SELECT symbol, dt, round(greatest(least(close, m + 2 * s), m - 2 * s), 6) AS by_z, round(greatest(least(close, hi), lo), 6) AS by_quantile FROM (SELECT *, avg(close) OVER p AS m, stddev_pop(close) OVER p AS s, quantile_cont(close, 0.05) OVER p AS lo, quantile_cont(close, 0.95) OVER p AS hi FROM bars WINDOW p AS (PARTITION BY symbol))""")
def b04_winsorise(spark, d):
    return rounded(w.winsorised(panels.bars(spark, d), "close", k=2.0), "symbol", "dt", by_z="by_z", by_quantile="by_quantile")


@register("""SELECT symbol, dt, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END, 6) AS minmax, round(CASE WHEN q3 > q1 THEN (close - m) / (q3 - q1) ELSE 0 END, 6) AS robust, round(CASE WHEN s > 1e-12 THEN (close - a) / s ELSE 0 END, 6) AS zfull
FROM (SELECT *, min(close) OVER p AS lo, max(close) OVER p AS hi, avg(close) OVER p AS a, stddev_pop(close) OVER p AS s, quantile_cont(close, 0.5) OVER p AS m, quantile_cont(close, 0.25) OVER p AS q1, quantile_cont(close, 0.75) OVER p AS q3 FROM bars WINDOW p AS (PARTITION BY symbol))""")
def b05_scale(spark, d):
    return rounded(w.scaled(panels.bars(spark, d), "close"), "symbol", "dt", minmax="minmax", robust="robust", zfull="zfull")
