"""Queries of the universe-level jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.operators import aggregates as a
from spreadloom.operators import features as k
from spreadloom.operators import risk as r
from spreadloom.operators import scoring as sc
from spreadloom.operators import universe as u
from spreadloom.operators import windows as w
from spreadloom.plans.job_queries import bar_returns, predictions
from spreadloom.plans.pair_queries import PAIRS, pairs_of
from spreadloom.plans.registry import register
from spreadloom.plans.table_queries import LEGS, r6, sql6
from spreadloom.plans.window_queries import RET, W
from spreadloom.sources import panels

SIG = PAIRS + """, rb AS (SELECT pair_id, dt, CASE WHEN count(*) OVER v = 24 THEN y - regr_slope(y, x) OVER v * x END AS spread, CASE WHEN count(*) OVER v = 24 THEN corr(x, y) OVER v END AS corr FROM px WINDOW v AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
rz AS (SELECT *, CASE WHEN count(spread) OVER v = 24 THEN (spread - avg(spread) OVER v) / nullif(stddev_pop(spread) OVER v, 0) END AS z, row_number() OVER (PARTITION BY pair_id ORDER BY dt DESC) AS age FROM rb WINDOW v AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
sg AS (SELECT pair_id, dt, z, corr, abs(z) * (0.5 + 0.5 * abs(corr)) AS score FROM rz WHERE age = 1 AND z IS NOT NULL), st AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, pair_id) AS rank, count(*) OVER () AS n FROM sg)"""


@register(f"{SIG} SELECT pair_id, dt, {sql6(['z', 'corr', 'score'], 5)}, rank, rank <= greatest(1, ceil(n * 0.2)) AS is_core, abs(z) >= 2 AS is_extreme FROM st", "month")
def j05_signal_table(spark, d):
    return r6(u.signal_table(pairs_of(spark, d), 24), "pair_id", "dt", "rank", "is_core", "is_extreme", six=["z", "corr", "score"], places=5)


@register(f"{SIG} SELECT count(*) AS n, round(avg(abs(z)), 5) AS mean_abs_z, round(max(abs(z)), 5) AS max_abs_z, round(avg(corr), 5) AS mean_corr, count(*) FILTER (WHERE rank <= greatest(1, ceil(n * 0.2))) AS n_core, count(*) FILTER (WHERE abs(z) >= 2) AS n_extreme FROM st", "month")
def d24_signal_summary(spark, d):
    return r6(u.signal_summary(u.signal_table(pairs_of(spark, d), 24)), "n", "n_core", "n_extreme", six=["mean_abs_z", "max_abs_z", "mean_corr"], places=5)


@register(f"{SIG} SELECT pair_id, round(z, 5) AS z, CASE WHEN abs(z) >= 2 THEN 'now' WHEN abs(z) >= 1.5 THEN 'soon' ELSE 'later' END AS \"window\" FROM st WHERE abs(z) >= 1", "month")
def j06_execution_filter(spark, d):
    return r6(u.for_execution(u.signal_table(pairs_of(spark, d), 24), 1.0, [(2.0, "now"), (1.5, "soon")]), "pair_id", "window", six=["z"], places=5)


@register(""", q AS (SELECT symbol, dt, greatest(least(close, quantile_cont(close, 0.95) OVER p), quantile_cont(close, 0.05) OVER p) AS c, greatest(least(volume, quantile_cont(volume, 0.95) OVER p), quantile_cont(volume, 0.05) OVER p) AS v FROM bars WINDOW p AS (PARTITION BY dt)),
s AS (SELECT symbol, dt, 100 - 100 * (rank() OVER (PARTITION BY dt ORDER BY c) + (count(*) OVER (PARTITION BY dt, c) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) AS close_score, 100 * (rank() OVER (PARTITION BY dt ORDER BY v) + (count(*) OVER (PARTITION BY dt, v) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) AS volume_score FROM q)
SELECT symbol, dt, round(close_score, 5) + 0.0 AS close_score, round(volume_score, 5) + 0.0 AS volume_score, round((2 * close_score + volume_score) / 3, 5) + 0.0 AS composite FROM s""", "month")
def j07_fundamental_scores(spark, d):
    s = u.fundamental_scores(panels.bars(spark, d, "month").select("symbol", "dt", "close", "volume"), {"close": (2.0, True), "volume": (1.0, False)})
    return r6(s, "symbol", "dt", six=["close_score", "volume_score", "composite"], places=5)


@register(f"""{RET}, f AS (SELECT symbol, stddev_samp(log_ret) AS vol, abs(min(log_ret)) AS tail FROM r WHERE ret IS NOT NULL GROUP BY 1), q AS (SELECT *, quantile_cont(vol, 0.5) OVER () AS vm, (quantile_cont(vol, 0.75) OVER () - quantile_cont(vol, 0.25) OVER ()) / 1.349 AS vi, quantile_cont(tail, 0.5) OVER () AS tm, (quantile_cont(tail, 0.75) OVER () - quantile_cont(tail, 0.25) OVER ()) / 1.349 AS ti FROM f),
z AS (SELECT symbol, 0.7 * greatest(0, (vol - vm) / vi) + 0.3 * greatest(0, (tail - tm) / ti) AS raw FROM q) SELECT symbol, round(20 * (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 5) AS penalty, round(60 - 20 * (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 5) AS adjusted FROM z""")
def j09_risk_overlay(spark, d):
    f = bar_returns(spark, d).groupBy("symbol").agg(F.stddev_samp("log_ret").alias("vol"), F.abs(F.min("log_ret")).alias("tail")).withColumn("score", F.lit(60.0))
    return r6(u.risk_overlay(f, "score", {"vol": 0.7, "tail": 0.3}), "symbol", six=["penalty", "adjusted"], places=5)


REG = """, mz AS (SELECT dt, (discount - avg(discount) OVER e) / nullif(stddev_pop(discount) OVER e, 0) AS g, (tax - avg(tax) OVER e) / nullif(stddev_pop(tax) OVER e, 0) AS i FROM macro WINDOW e AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rg AS (SELECT dt, CASE WHEN g IS NULL OR i IS NULL THEN 'unknown' WHEN g > 0.5 AND i <= 0.5 THEN 'growth' WHEN g < -0.5 AND i > 0.5 THEN 'stagflation' WHEN i > 0.5 THEN 'inflation' WHEN g < -0.5 THEN 'recession' ELSE 'neutral' END AS regime FROM mz)"""
MULT = {"growth": 1.2, "stagflation": 0.5, "inflation": 0.8, "recession": 0.6, "neutral": 1.0}


def regimes(spark, d):
    return sc.macro_regimes(panels.macro(spark, d), "discount", "tax").select("dt", "regime")


@register(f"""{REG}, f AS (SELECT symbol AS pair_id, dt, volume * coalesce(CASE regime WHEN 'growth' THEN 1.2 WHEN 'stagflation' THEN 0.5 WHEN 'inflation' THEN 0.8 WHEN 'recession' THEN 0.6 WHEN 'neutral' THEN 1.0 END, 1.0) AS fit FROM bars LEFT JOIN rg USING (dt))
SELECT pair_id, dt, round(fit, 6) AS fit, coalesce(last_value(CASE WHEN fit >= 180 THEN true WHEN fit < 120 THEN false END IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS include FROM f""")
def j16_macro_adjustment(spark, d):
    b = panels.bars(spark, d).select(F.col("symbol").alias("pair_id"), "dt", F.col("volume").alias("score"))
    return r6(u.macro_adjusted(b, regimes(spark, d), MULT, 180.0, 120.0), "pair_id", "dt", "include", six=["fit"])


@register(f"{REG} SELECT dt, regime, round(avg((regime = 'growth')::INT::DOUBLE) OVER w, 6) AS p_growth, round(avg((regime = 'recession')::INT::DOUBLE) OVER w, 6) AS p_recession FROM rg WINDOW w AS (ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def j21_regime_probabilities(spark, d):
    return r6(u.regime_probabilities(regimes(spark, d), ["growth", "recession"]), "dt", "regime", six=["p_growth", "p_recession"])


@register("""SELECT id, round(m, 5) AS mean_distance, round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 4) AS z, (m - avg(m) OVER ()) / stddev_pop(m) OVER () >= 1.5 AS is_anomaly FROM (SELECT id, avg(g) AS m FROM (SELECT a.symbol AS id, abs(a.p - b.p) AS g FROM (SELECT symbol, avg(close) AS p FROM bars GROUP BY 1) a JOIN (SELECT symbol, avg(close) AS p FROM bars GROUP BY 1) b ON a.symbol <> b.symbol) GROUP BY 1)""")
def j22_profile_anomalies(spark, d):
    m = panels.bars(spark, d).groupBy("symbol").agg(F.avg("close").alias("p"))
    z = u.profile_anomalies(u.mean_gaps(m, "symbol", "p"), 1.5)
    return z.select("id", F.round("mean_distance", 5).alias("mean_distance"), F.round("z", 4).alias("z"), "is_anomaly")


@register(f"""{RET}, s AS (SELECT symbol, count(*) AS n, avg(log_ret) / stddev_samp(log_ret) AS sr, skewness(log_ret) AS dummy, avg(log_ret) AS m, stddev_pop(log_ret) AS sp FROM r WHERE ret IS NOT NULL GROUP BY 1),
c AS (SELECT symbol, avg((log_ret - m) ** 3) / max(sp) ** 3 AS sk, avg((log_ret - m) ** 4) / max(sp) ** 4 - 3 AS ku FROM r JOIN s USING (symbol) WHERE ret IS NOT NULL GROUP BY 1),
x AS (SELECT symbol, n, sr, (sr - 1.574598 / sqrt(n - 1)) / sqrt((1 - sk * sr + (ku + 2) / 4 * sr * sr) / (n - 1)) AS x FROM s JOIN c USING (symbol)) SELECT symbol, n, round(sr, 6) AS sharpe, round(1 / (1 + exp(-x * (1.5976 + 0.070565992 * x * x))), 4) AS dsr FROM x""")
def j18_deflated_sharpe(spark, d):
    g = bar_returns(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), (F.avg("log_ret") / F.stddev_samp("log_ret")).alias("sr"), F.skewness("log_ret").alias("sk"), F.kurtosis("log_ret").alias("ku"))
    return g.select("symbol", "n", F.round("sr", 6).alias("sharpe"), F.round(u.deflated_sharpe(F.col("sr"), 10, F.col("n"), F.col("sk"), F.col("ku")), 4).alias("dsr"))


@register(""", pr AS (SELECT pair, (pnl > 0)::INT AS y, (trade_id % 997) / 997.0::DOUBLE AS p1, (trade_id % 499) / 499.0::DOUBLE AS p2 FROM trades), m AS (SELECT pair, 'a' AS m, y, p1 AS p FROM pr UNION ALL SELECT pair, 'b', y, p2 FROM pr),
k AS (SELECT *, rank() OVER (PARTITION BY pair, m ORDER BY p) + (count(*) OVER (PARTITION BY pair, m, p) - 1) / 2.0 AS k FROM m), g AS (SELECT pair, m, (sum(y * k) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, avg((p - y) ** 2) AS brier FROM k GROUP BY 1, 2)
SELECT a.pair AS key, round(b.auc - a.auc, 6) AS auc_lift, round(a.brier - b.brier, 6) AS brier_cut, b.auc - a.auc > 0.01 AND a.brier - b.brier > 0.005 AS promote FROM g a JOIN g b ON a.pair = b.pair AND a.m = 'a' AND b.m = 'b'""")
def k21_champion_challenger(spark, d):
    t = panels.trades(spark, d)
    y = (F.col("pnl") > 0).cast("int").alias("y")
    both = t.select("pair", F.lit("a").alias("model"), y, ((F.col("trade_id") % 997) / 997.0).alias("p")).union(t.select("pair", F.lit("b").alias("model"), y, ((F.col("trade_id") % 499) / 499.0).alias("p")))
    m = k.classification_metrics(both, "y", "p", ["pair", "model"]).withColumnRenamed("pair", "key")
    return r6(u.champion_against(m, "a", "b"), "key", "promote", six=["auc_lift", "brier_cut"])


@register(f"""{RET}, f AS (SELECT symbol, dt, ret, close / lag(close, 5) OVER s - 1 AS ret_5, CASE WHEN count(log_ret) OVER v = 20 THEN stddev_samp(log_ret) OVER v END AS vol FROM r WINDOW s AS (PARTITION BY symbol ORDER BY dt), v AS {W.format(19)}) SELECT symbol, dt, round(((ret IS NULL)::INT + (ret_5 IS NULL)::INT + (vol IS NULL)::INT + 1) / 4.0::DOUBLE, 6) AS missing_share, ((ret IS NULL)::INT + (ret_5 IS NULL)::INT + (vol IS NULL)::INT + 1) / 4.0 <= 0.5 AS usable FROM f""")
def k24_missing_features(spark, d):
    f = k.computed(panels.bars(spark, d), ["ret_1", "ret_5", "vol_20"])
    return r6(u.missing_features(f, ["ret_1", "ret_5", "vol_20", "not_there"], 0.5), "symbol", "dt", "usable", six=["missing_share"])


@register(""", t AS (SELECT entry AS dt, sum(pnl) AS pnl FROM trades GROUP BY 1), c AS (SELECT *, sum(pnl) OVER (ORDER BY dt) AS cum FROM t), p AS (SELECT *, max(cum) OVER (ORDER BY dt) AS peak FROM c), q AS (SELECT *, max(CASE WHEN cum = peak THEN dt END) OVER (ORDER BY dt) AS peak_dt FROM p), w AS (SELECT dt AS trough, peak_dt, cum - peak AS depth FROM q ORDER BY cum - peak, dt LIMIT 1)
SELECT pair, round(sum(pnl), 2) AS pnl, round(least(sum(pnl), 0) / max(depth), 5) + 0.0 AS share FROM trades, w WHERE entry > peak_dt AND entry <= trough GROUP BY 1""")
def l07_drawdown_attribution(spark, d):
    x = u.drawdown_attribution(panels.trades(spark, d).select("pair", F.col("entry").alias("dt"), "pnl"))
    return x.select("pair", F.round("pnl", 2).alias("pnl"), (F.round("share", 5) + 0.0).alias("share"))


@register(f"""{LEGS}, h AS (SELECT symbol FROM legs GROUP BY 1 HAVING sum(abs(notional)) > 50000), s AS (SELECT pair, leg_x, leg_y, least(greatest(notional_x / 10000, 0), 1) AS a, CASE WHEN strategy = 'core' THEN 1.0 ELSE 0.5 END AS b FROM positions), o AS (SELECT *, 0.7 * a + 0.3 * b - 0.1 * ((leg_x IN (SELECT symbol FROM h))::INT + (leg_y IN (SELECT symbol FROM h))::INT) AS score FROM s)
SELECT pair, round(score, 7) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, pair) AS rank FROM o WHERE score >= 0.2""")
def l09_opportunities(spark, d):
    p = panels.positions(spark, d).withColumns({"size": F.col("notional_x") / 10000, "kind": F.when(F.col("strategy") == "core", 1.0).otherwise(0.5)})
    held = a.legs(panels.positions(spark, d)).groupBy("symbol").agg(F.sum(F.abs("notional")).alias("g")).where("g > 50000")
    return r6(u.opportunities(p, {"size": 0.7, "kind": 0.3}, held, 0.1, 0.2), "pair", "rank", six=["score"], places=7)


@register(f"""{RET}, q AS (SELECT symbol, dt, ret AS r, exp(sum(ln(1 + ret)) OVER s) AS eq FROM r WHERE ret IS NOT NULL WINDOW s AS (PARTITION BY symbol ORDER BY dt)), g AS (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY symbol ORDER BY dt), 1) - 1 AS dd FROM q), s AS (SELECT symbol, stddev_samp(r) AS vol, min(dd) AS dd FROM g GROUP BY 1),
k AS (SELECT symbol, least(greatest(100 * (0.6 * least(vol / 0.4, 1) + 0.4 * least(-dd / 0.3, 1)), 0), 100) AS risk FROM s) SELECT symbol, round(risk, 5) AS risk_score, round(least(greatest(1 - risk / 100, 0.2), 1), 5) AS scale FROM k""")
def l15_dynamic_limits(spark, d):
    x = bar_returns(spark, d)
    state = r.performance(x, "ret", "symbol").select("symbol", F.col("max_drawdown").alias("drawdown")).join(x.groupBy("symbol").agg(F.stddev_samp("ret").alias("vol")), "symbol")
    return r6(u.dynamic_limits(state, 1e6, "symbol"), "symbol", six=["risk_score", "scale"], places=5)


@register("SELECT field, round(avg(v) FILTER (WHERE a), 5) AS mean_a, round(avg(v) FILTER (WHERE NOT a), 5) AS mean_b, round(quantile_cont(v, 0.5) FILTER (WHERE a), 5) AS median_a, round(quantile_cont(v, 0.5) FILTER (WHERE NOT a), 5) AS median_b, round(avg(v) FILTER (WHERE a) - avg(v) FILTER (WHERE NOT a), 5) AS diff FROM (SELECT p_type = 'PROMO' AS a, unnest(['price', 'size']) AS field, unnest([p_retailprice, p_size::DOUBLE]) AS v FROM part) GROUP BY 1")
def m12_universe_comparison(spark, d):
    p = panels.table(spark, d, "part").select("p_type", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return r6(u.coverage_compared(p, F.col("p_type") == "PROMO", ["price", "size"]), "field", six=["mean_a", "mean_b", "median_a", "median_b", "diff"], places=5)


@register("SELECT trial_id, round(exp(0.75 * ln(greatest(least(sharpe / 4, 1), 1e-9)) + 0.25 * ln(greatest(least((score - 800) / 1200, 1), 1e-9))), 6) AS geometric, round(0.75 * least(sharpe / 4, 1) + 0.25 * greatest(least((score - 800) / 1200, 1), 0), 9) AS weighted FROM trials")
def o06_weighted_scores(spark, d):
    g = u.geometric_score(panels.trials(spark, d), {"sharpe": (0.0, 4.0, 3.0), "score": (800.0, 2000.0, 1.0)})
    return g.select("trial_id", F.round("geometric", 6).alias("geometric"), F.round("weighted", 9).alias("weighted"))


@register("SELECT symbol, dt, round(high - low, 6) AS high_minus_low, round(close - open, 6) AS close_minus_open FROM bars")
def o07_combined_columns(spark, d):
    return r6(u.combined(panels.bars(spark, d), [("high", "low"), ("close", "open")], lambda x, y: x - y, "minus"), "symbol", "dt", six=["high_minus_low", "close_minus_open"])


@register("SELECT pair, sum(v * v) AS folded FROM (SELECT p_brand AS pair, p_size % 12 AS id, count(*)::DOUBLE AS v FROM part GROUP BY 1, 2) GROUP BY 1")
def o03_matrix_fold(spark, d):
    cells = panels.table(spark, d, "part").groupBy(F.col("p_brand").alias("pair"), (F.col("p_size") % 12).alias("id")).agg(F.count("*").cast("double").alias("v"))
    m = sc.matrices(cells.select("pair", F.expr("id div 4").cast("int").alias("r"), (F.col("id") % 4).cast("int").alias("c"), "v"), "pair", 3, 4)
    return u.folded(m, "pair", lambda v: v * v, 0.0, lambda acc, v: acc + v).select("pair", "folded")


@register(f"""{RET}, q AS (SELECT symbol, dt, log_ret, CASE WHEN count(log_ret) OVER v = 40 THEN (log_ret - avg(log_ret) OVER v) / nullif(stddev_pop(log_ret) OVER v, 0) END AS z, CASE WHEN count(log_ret) OVER v = 40 THEN (log_ret - quantile_cont(log_ret, 0.5) OVER v) / nullif((quantile_cont(log_ret, 0.75) OVER v - quantile_cont(log_ret, 0.25) OVER v) / 1.349, 0) END AS iqr FROM (SELECT symbol, dt, log_ret FROM r WHERE ret IS NOT NULL) WINDOW v AS {W.format(39)})
SELECT symbol, dt, round(z, 5) AS z, round(iqr, 5) AS iqr FROM q WHERE abs(z) > 2.2 OR abs(iqr) > 2.5""")
def i27_anomaly_votes(spark, d):
    return r6(u.anomaly_votes(bar_returns(spark, d), 40, 2.2, 2.5), "symbol", "dt", six=["z", "iqr"], places=5)


@register("""SELECT trial_id, round(2 * m, 6) AS entry, round(least(CASE WHEN hl < 5 THEN least(0.5 * least(m, 1.5), 0.2) WHEN hl > 60 THEN greatest(0.5 * least(m, 1.5), 0.8) ELSE 0.5 * least(m, 1.5) END, 2 * m), 6) AS exit, round(greatest(4 * greatest(m, 1), 2 * m), 6) AS stop FROM (SELECT trial_id, least(greatest((sharpe + 0.1) / (drawdown * 3 + 0.5), 0.5), 2) AS m, study_id * 2 AS hl FROM trials)""")
def i31_adaptive_thresholds(spark, d):
    t = panels.trials(spark, d).select("trial_id", (F.col("sharpe") + 0.1).alias("vol"), (F.col("drawdown") * 3 + 0.5).alias("base_vol"), (F.col("study_id") * 2).alias("half_life"))
    return r6(u.adaptive_thresholds(t), "trial_id", six=["entry", "exit", "stop"])


@register("SELECT event_id, kind AS \"m.kind\", price AS \"m.price\", CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM ticks")
def h09_flatten_and_merge(spark, d):
    t = panels.ticks(spark, d).select("event_id", F.struct("kind", "price").alias("m"), F.create_map(F.lit("k"), F.lit("old")).alias("a"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("new"))).otherwise(F.create_map(F.lit("z"), F.lit("new"))).alias("b"))
    return u.merged_maps(u.flattened(t, "m"), "a", "b", "c").select("event_id", "`m.kind`", "`m.price`", F.col("c")["k"].alias("v"))
