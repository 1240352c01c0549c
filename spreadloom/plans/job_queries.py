"""Queries of features, labels, evaluation, risk, data quality and universe scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.functions import columns as x
from spreadloom.operators import aggregates as a
from spreadloom.operators import features as k
from spreadloom.operators import pairs as p
from spreadloom.operators import quality as m
from spreadloom.operators import risk as r
from spreadloom.operators import windows as w
from spreadloom.plans.pair_queries import HEDGE, PAIRS
from spreadloom.plans.registry import register
from spreadloom.plans.table_queries import LEGS, r6, sql6
from spreadloom.plans.window_queries import RET, W, ZSQL, bar_z
from spreadloom.sources import panels


@register(f"""{RET} SELECT symbol, dt, round(ret, 6) AS ret_1, round(close / lag(close, 5) OVER s - 1, 6) AS ret_5, round(close / lag(close, 20) OVER s - 1, 6) AS ret_20, CASE WHEN count(log_ret) OVER v = 20 THEN round(stddev_samp(log_ret) OVER v, 6) END AS vol_20,
round(CASE WHEN count(log_ret) OVER l = 60 THEN stddev_samp(log_ret) OVER v / nullif(stddev_samp(log_ret) OVER l, 0) END, 6) AS vol_ratio, CASE WHEN count(volume) OVER v = 20 THEN round(volume / avg(volume) OVER v, 6) END AS volume_ratio FROM r WINDOW s AS (PARTITION BY symbol ORDER BY dt), v AS {W.format(19)}, l AS {W.format(59)}""")
def k01_instrument_features(spark, d):
    names = ["ret_1", "ret_5", "ret_20", "vol_20", "vol_ratio", "volume_ratio"]
    return r6(k.computed(panels.bars(spark, d), names), "symbol", "dt", six=names)


SPZ = HEDGE + ", zs AS (SELECT pair_id, dt, CASE WHEN count(spread) OVER v = 20 THEN (spread - avg(spread) OVER v) / nullif(stddev_pop(spread) OVER v, 0) END AS z FROM sp WINDOW v AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"


def spread_z(spark, d):
    pairs = p.all_pairs(panels.bars(spark, d, "month"), "vwap")
    s = p.spread(pairs, p.static_hedge(pairs))
    return s.select("pair_id", "dt", x.zscore("spread", x.trailing(20, "pair_id"), 20).alias("z"))


ZF = ["z_abs", "z_mean", "z_std", "z_mom", "z_ar1", "z_accel"]


@register(f"""{SPZ}, b AS (SELECT *, lag(z) OVER s AS b, lag(z, 2) OVER s AS b2, lag(z, 5) OVER s AS b5, (sign(z) <> sign(lag(z) OVER s))::INT AS c FROM zs WINDOW s AS (PARTITION BY pair_id ORDER BY dt)),
f AS (SELECT pair_id, dt, abs(z) AS z_abs, CASE WHEN count(z) OVER v = 20 THEN avg(z) OVER v END AS z_mean, CASE WHEN count(z) OVER v = 20 THEN stddev_samp(z) OVER v END AS z_std, z - b5 AS z_mom, CASE WHEN count(b) OVER v = 20 THEN regr_slope(z, b) OVER v END AS z_ar1, CASE WHEN count(c) OVER v = 20 THEN sum(c) OVER v END::BIGINT AS z_crossings, z - 2 * b + b2 AS z_accel
FROM b WINDOW v AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT pair_id, dt, z_crossings, {sql6(ZF, 5)} FROM f""", "month")
def k02_pair_features(spark, d):
    return r6(k.z_features(spread_z(spark, d)), "pair_id", "dt", "z_crossings", six=ZF, places=5)


@register(f"""{SPZ}, n AS (SELECT *, count(z) OVER w AS n, min(z) OVER w AS lo, max(z) OVER w AS hi, lead(z, 6) OVER (PARTITION BY pair_id ORDER BY dt) AS e FROM zs WINDOW w AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))
SELECT pair_id, dt, CASE WHEN ok THEN (CASE WHEN z > 0 THEN lo ELSE -hi END <= 0.5 * abs(z))::INT END AS reverts, round(CASE WHEN ok THEN sign(z) * (z - e) END, 5) + 0.0 AS gain, round(CASE WHEN ok THEN CASE WHEN z > 0 THEN hi ELSE -lo END - abs(z) END, 5) + 0.0 AS adverse FROM (SELECT *, abs(z) >= 1.5 AND n = 6 AS ok FROM n)""", "month")
def k05_forward_labels(spark, d):
    return r6(k.z_labels(spread_z(spark, d), horizon=6, entry=1.5), "pair_id", "dt", "reverts", six=["gain", "adverse"], places=5)


@register(f"""{SPZ} SELECT pair_id, dt, CASE WHEN count(z) OVER b = 8 AND count(z) OVER f = 8 THEN (var_pop(z) OVER f / nullif(var_pop(z) OVER b, 0) > 2)::INT END AS var_spike FROM zs WINDOW b AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), f AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)""", "month")
def k06_variance_spike(spark, d):
    return k.variance_spike(spread_z(spark, d), "z", 8).select("pair_id", "dt", "var_spike")


@register(f"""{SPZ} SELECT pair_id, dt, CASE WHEN abs(z) >= 1.5 THEN coalesce(list_position(list_transform(list(z) OVER f, lambda v: abs(v) <= 0.5), true), 12)::BIGINT END AS bars_to_target FROM zs WINDOW f AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)""", "month")
def k07_time_to_target(spark, d):
    return k.time_to_target(spread_z(spark, d), 12, 0.5, 1.5).select("pair_id", "dt", F.col("bars_to_target").cast("long").alias("bars_to_target"))


@register(f"""{SPZ}, n AS (SELECT dt, row_number() OVER (ORDER BY dt) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT dt FROM zs)), t AS (SELECT zs.*, CASE WHEN rn <= floor(n * 0.6) - 2 THEN 'train' WHEN rn <= floor(n * 0.6) THEN NULL WHEN rn <= floor(n * 0.8) - 2 THEN 'validation' WHEN rn <= floor(n * 0.8) THEN NULL ELSE 'test' END AS part FROM zs JOIN n USING (dt))
SELECT part, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt FROM t WHERE part IS NOT NULL GROUP BY 1""", "month")
def k09_chronological_split(spark, d):
    return k.chronological_split(spread_z(spark, d), purge=2).groupBy("part").agg(F.count("*").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@register("""SELECT fold, max(dt) FILTER (WHERE part = 'train') AS train_end, min(dt) FILTER (WHERE part = 'test') AS test_start, date_diff('day', max(dt) FILTER (WHERE part = 'train'), min(dt) FILTER (WHERE part = 'test'))::INT AS gap_days,
date_diff('day', max(dt) FILTER (WHERE part = 'train'), min(dt) FILTER (WHERE part = 'test')) <= 0 AS overlaps, date_diff('day', max(dt) FILTER (WHERE part = 'train'), min(dt) FILTER (WHERE part = 'test')) < 10 AS embargo_broken, date_diff('day', max(dt) FILTER (WHERE part = 'train'), min(dt) FILTER (WHERE part = 'test')) < 40 AS label_reaches_test, avg((volume < 2)::INT) > 0.3 AS too_many_nulls
FROM (SELECT volume, dt, year(dt)::INT % 2 AS fold, CASE WHEN month(dt) <= 6 THEN 'train' ELSE 'test' END AS part FROM segs WHERE year(dt) IN (1997, 1998)) GROUP BY 1""")
def k10_leakage_audit(spark, d):
    s = panels.segment_bars(spark, d).where(F.year("dt").isin(1997, 1998)).select("dt", (F.year("dt") % 2).alias("fold"), F.when(F.month("dt") <= 6, "train").otherwise("test").alias("part"), F.when(F.col("volume") >= 2, 1).alias("label"))
    return k.leakage_audit(s, 10, 30, "label")


PRED = ", pred AS (SELECT pair, (pnl > 0)::INT AS y, (trade_id % 997) / 997.0::DOUBLE AS p FROM trades)"


def predictions(spark, d):
    return panels.trades(spark, d).select("pair", (F.col("pnl") > 0).cast("int").alias("y"), ((F.col("trade_id") % 997) / 997.0).alias("p"), "pnl")


@register(f"""{PRED}, k AS (SELECT *, rank() OVER (PARTITION BY pair ORDER BY p) + (count(*) OVER (PARTITION BY pair, p) - 1) / 2.0 AS k, least(floor(p * 10), 9) AS b FROM pred),
e AS (SELECT pair, sum(m * gap) / sum(m) AS ece FROM (SELECT pair, b, count(*) AS m, abs(avg(p) - avg(y)) AS gap FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT pair, n, round(auc, 6) AS auc, round(brier, 6) AS brier, round(base, 6) AS base_rate, round(ece, 6) AS ece FROM (SELECT pair, count(*) AS n, (sum(y * k) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, avg((p - y) ** 2) AS brier, avg(y) AS base FROM k GROUP BY 1) JOIN e USING (pair)""")
def k15_classification_metrics(spark, d):
    return r6(k.classification_metrics(predictions(spark, d), "y", "p", ["pair"]), "pair", "n", six=["auc", "brier", "base_rate", "ece"])


@register(""", k AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY pnl) + (count(*) OVER (PARTITION BY pair, pnl) - 1) / 2.0 AS a, rank() OVER (PARTITION BY pair ORDER BY trade_id % 997) + (count(*) OVER (PARTITION BY pair, trade_id % 997) - 1) / 2.0 AS b FROM trades)
SELECT pair, n, round(ic, 6) AS ic, round(ic * sqrt(n) / sqrt(1 - ic * ic), 5) AS t_stat FROM (SELECT pair, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY 1)""")
def k16_information_coefficient(spark, d):
    ic = k.information_coefficient(predictions(spark, d), "pnl", "p", ["pair"])
    return ic.select("pair", "n", F.round("ic", 6).alias("ic"), F.round("t_stat", 5).alias("t_stat"))


@register(""", rf AS (SELECT symbol, close FROM segs WHERE dt < '1998-07-01'), cu AS (SELECT symbol, close FROM segs WHERE dt >= '1998-07-01'), e AS (SELECT symbol, list_sort(list_distinct(quantile_cont(close, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM rf GROUP BY 1),
b AS (SELECT t, symbol, greatest(1, least(len(edges) - 1, len(list_filter(edges, lambda v: v <= close)))) AS bin FROM (SELECT 'r' AS t, * FROM rf UNION ALL SELECT 'c', * FROM cu) JOIN e USING (symbol) WHERE close >= edges[1] AND close <= edges[-1]),
n AS (SELECT symbol, bin, count(*) FILTER (WHERE t = 'r') AS r, count(*) FILTER (WHERE t = 'c') AS c FROM b GROUP BY 1, 2), s AS (SELECT symbol, greatest(r / sum(r) OVER p::DOUBLE, 1e-4) AS r, greatest(c / sum(c) OVER p::DOUBLE, 1e-4) AS c FROM n WINDOW p AS (PARTITION BY symbol))
SELECT symbol, round(sum((c - r) * ln(c / r)), 6) AS psi, CASE WHEN sum((c - r) * ln(c / r)) > 0.25 THEN 'major' WHEN sum((c - r) * ln(c / r)) > 0.1 THEN 'minor' ELSE 'none' END AS severity FROM s GROUP BY 1""")
def k17_psi(spark, d):
    s = panels.segment_bars(spark, d)
    return r6(k.psi(s.where("dt < '1998-07-01'"), s.where("dt >= '1998-07-01'"), "close", ["symbol"]), "symbol", "severity", six=["psi"])


@register(""", u AS (SELECT symbol, close, sum((dt < '1998-07-01')::INT) AS r, sum((dt >= '1998-07-01')::INT) AS c FROM segs GROUP BY 1, 2) SELECT symbol, round(max(gap), 6) AS ks FROM (SELECT symbol, abs(sum(r) OVER o / sum(r) OVER t::DOUBLE - sum(c) OVER o / sum(c) OVER t::DOUBLE) AS gap FROM u WINDOW o AS (PARTITION BY symbol ORDER BY close), t AS (PARTITION BY symbol)) GROUP BY 1""")
def k17_kolmogorov_smirnov(spark, d):
    s = panels.segment_bars(spark, d)
    return r6(k.kolmogorov_smirnov(s.where("dt < '1998-07-01'"), s.where("dt >= '1998-07-01'"), "close", ["symbol"]), "symbol", six=["ks"])


@register("SELECT pair, count(*) AS n, round(avg((pnl > 0)::INT::DOUBLE), 6) AS win_rate, round(coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0), 3) AS avg_win, round(coalesce(avg(-pnl) FILTER (WHERE pnl < 0), 0), 3) AS avg_loss, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 6) AS sharpe FROM trades GROUP BY 1 HAVING count(*) >= 20")
def k19_sizing_statistics(spark, d):
    g = a.trade_kpis(panels.trades(spark, d), ["pair"]).where("n >= 20")
    return g.select("pair", "n", F.round("win_rate", 6).alias("win_rate"), F.round(F.coalesce("avg_win", F.lit(0.0)), 3).alias("avg_win"), F.round(F.coalesce(-F.col("avg_loss"), F.lit(0.0)), 3).alias("avg_loss"), F.round(F.col("mean") / F.col("sd") * 252**0.5, 6).alias("sharpe"))


@register("SELECT pair, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(abs((p - y) / nullif(y, 0))), 6) AS mape, round(avg(p - y) / stddev_pop(p - y), 6) AS error_sharpe FROM (SELECT pair, (trade_id % 997) / 997.0::DOUBLE AS p, (pnl > 0)::INT AS y FROM trades) GROUP BY 1")
def k22_regression_metrics(spark, d):
    return r6(k.regression_metrics(predictions(spark, d), "y", "p", ["pair"]), "pair", six=["rmse", "mape", "error_sharpe"])


@register(f"{ZSQL} SELECT symbol, dt, round(z - lead(z, 5) OVER (PARTITION BY symbol ORDER BY dt), 6) AS fwd_reversion FROM zz")
def k23_reversion_label(spark, d):
    return r6(k.z_reversion(bar_z(spark, d), 5, key="symbol"), "symbol", "dt", six=["fwd_reversion"])


def bar_returns(spark, d):
    return w.returns(panels.bars(spark, d)).where("ret IS NOT NULL").select("symbol", "dt", "ret", "log_ret")


Z95 = "1.6448536269514722"


@register(f"""{RET}, q AS (SELECT symbol, log_ret AS r, quantile_cont(log_ret, 0.05) OVER (PARTITION BY symbol) AS q FROM r WHERE ret IS NOT NULL), s AS (SELECT symbol, count(*) AS n, max(q) AS q, avg(r) AS m, stddev_samp(r) AS sd, avg(r) FILTER (WHERE r <= q) AS es FROM q GROUP BY 1),
c AS (SELECT symbol, avg((r - m) ** 3) / max(sp) ** 3 AS sk, avg((r - m) ** 4) / max(sp) ** 4 - 3 AS ku FROM q JOIN (SELECT symbol, avg(r) AS m, stddev_pop(r) AS sp FROM q GROUP BY 1) USING (symbol) GROUP BY 1)
SELECT symbol, n, round(q, 6) AS var_hist, round(m - {Z95} * sd, 6) AS var_param, round(m + (-{Z95} + ({Z95} ** 2 - 1) * sk / 6 + (-({Z95} ** 3) + 3 * {Z95}) * ku / 24 - (-2 * {Z95} ** 3 + 5 * {Z95}) * sk * sk / 36) * sd, 6) AS var_cf, round(es, 6) AS es FROM s JOIN c USING (symbol)""")
def l01_value_at_risk(spark, d):
    return r6(r.value_at_risk(bar_returns(spark, d), "log_ret", "symbol"), "symbol", "n", six=["var_hist", "var_param", "var_cf", "es"])


TR = ["skew", "kurt", "omega", "gain_pain", "worst", "worst_five"]


@register(f"""{RET}, f AS (SELECT symbol, log_ret AS r, CASE WHEN count(log_ret) OVER v = 5 THEN sum(log_ret) OVER v END AS five FROM r WHERE ret IS NOT NULL WINDOW v AS {W.format(4)}), m AS (SELECT symbol, count(*) AS n, avg(r) AS m, stddev_pop(r) AS sp FROM f GROUP BY 1),
s AS (SELECT symbol, avg((r - m) ** 3) / max(sp) ** 3 AS skew, avg((r - m) ** 4) / max(sp) ** 4 - 3 AS kurt, max(n) AS n, sum(greatest(r, 0)) / abs(sum(least(r, 0))) AS omega, sum(r) / abs(sum(least(r, 0))) AS gain_pain, min(r) AS worst, min(five) AS worst_five FROM f JOIN m USING (symbol) GROUP BY 1)
SELECT symbol, {sql6(TR, 5)}, round(n / 6 * (skew * skew + kurt * kurt / 4), 4) AS jarque_bera FROM s""")
def l02_tail_risk(spark, d):
    t = r.tail_risk(bar_returns(spark, d), "log_ret", "symbol")
    return t.select("symbol", *[(F.round(c, 5) + 0.0).alias(c) for c in TR], F.round("jarque_bera", 4).alias("jarque_bera"))


BEN = ["beta", "alpha", "r2", "tracking_error", "info_ratio", "hit_rate", "up_capture", "down_capture"]


@register(f"""{RET}, j AS (SELECT r.symbol, r.log_ret AS a, b.b FROM r JOIN (SELECT dt, avg(log_ret) AS b FROM r WHERE ret IS NOT NULL GROUP BY 1) b USING (dt) WHERE ret IS NOT NULL)
SELECT symbol, n, {sql6(BEN, 5)} FROM (SELECT symbol, count(*) AS n, regr_slope(a, b) AS beta, (avg(a) - regr_slope(a, b) * avg(b)) * 252 AS alpha, regr_r2(a, b) AS r2, stddev_samp(a - b) * sqrt(252) AS tracking_error, avg(a - b) / stddev_samp(a - b) * sqrt(252) AS info_ratio, avg((a > b)::INT::DOUBLE) AS hit_rate, avg(a) FILTER (WHERE b > 0) / avg(b) FILTER (WHERE b > 0) AS up_capture, avg(a) FILTER (WHERE b < 0) / avg(b) FILTER (WHERE b < 0) AS down_capture FROM j GROUP BY 1)""")
def l03_benchmark(spark, d):
    one = bar_returns(spark, d)
    bench = one.groupBy("dt").agg(F.avg("log_ret").alias("bench"))
    return r6(r.against_benchmark(one.join(bench, "dt"), "log_ret", "bench", "symbol"), "symbol", "n", six=BEN, places=5)


COVS = PAIRS + ", cv AS (SELECT symbol AS sym_x, symbol AS sym_y, var_samp(vwap) AS cov FROM bars GROUP BY 1 UNION ALL SELECT sym_x, sym_y, covar_samp(x, y) FROM px GROUP BY 1, 2 UNION ALL SELECT sym_y, sym_x, covar_samp(x, y) FROM px GROUP BY 1, 2), wt AS (SELECT DISTINCT symbol, 0.04::DOUBLE AS weight FROM bars)"


@register(f"""{COVS}, c AS (SELECT sym_x AS symbol, sum(cov * 0.04) AS cw FROM cv GROUP BY 1), t AS (SELECT sqrt(sum(0.04 * cw)) AS vol FROM c) SELECT symbol, weight, round(0.04 * cw / vol, 3) AS contribution, round(cw / vol, 2) AS marginal FROM c JOIN wt USING (symbol), t""", "month")
def l04_risk_contributions(spark, d):
    series = panels.bars(spark, d, "month")
    cov = r.both_triangles(p.shrunk_covariance(p.all_pairs(series, "vwap"), series, "vwap", 0.0))
    weights = series.select("symbol").distinct().withColumn("weight", F.lit(0.04))
    return r.risk_contributions(weights, cov).select("symbol", "weight", F.round("contribution", 3).alias("contribution"), F.round("marginal", 2).alias("marginal"))


@register(f"""{RET}, v AS (SELECT symbol, stddev_samp(log_ret) AS vol FROM r WHERE ret IS NOT NULL GROUP BY 1), q AS (SELECT symbol, vol, least(1 / vol / sum(1 / vol) OVER (), 0.041) AS cut FROM v), u AS (SELECT symbol, vol, cut / sum(cut) OVER () AS weight FROM q),
g AS (SELECT u.*, sector, weight * least(1, 0.2 / sum(weight) OVER (PARTITION BY sector)) AS c FROM u JOIN meta USING (symbol)) SELECT symbol, sector, round(vol, 6) AS vol, round(weight, 6) AS weight, round(c / sum(c) OVER (), 6) AS capped FROM g""")
def l05_weights_and_caps(spark, d):
    weights = r.inverse_vol_weights(bar_returns(spark, d), "log_ret", "symbol", 0.041).join(panels.meta(spark, d).select("symbol", "sector"), "symbol")
    return r6(r.group_capped(weights, "sector", 0.2), "symbol", "sector", six=["vol", "weight", "capped"])


@register(f"""{LEGS}, n AS (SELECT symbol, sum(notional) AS now FROM legs GROUP BY 1), t AS (SELECT symbol, n_parts / sum(n_parts) OVER ()::DOUBLE AS weight FROM meta), b AS (SELECT coalesce(n.symbol, t.symbol) AS symbol, coalesce(now, 0) AS now, coalesce(weight, 0) * 500000 AS want FROM n FULL JOIN t ON n.symbol = t.symbol)
SELECT symbol, round(now, 3) AS now, round(want, 3) AS want, round(CASE WHEN abs(want - now) / 500000 >= 0.02 THEN want - now ELSE 0 END, 3) + 0.0 AS trade, round(CASE WHEN abs(want - now) / 500000 >= 0.02 THEN abs(want - now) ELSE 0 END * 3 / 1e4, 4) AS cost FROM b""")
def l08_rebalance(spark, d):
    now = a.legs(panels.positions(spark, d)).groupBy("symbol").agg(F.sum("notional").alias("notional"))
    meta = panels.meta(spark, d)
    total = meta.agg(F.sum("n_parts").alias("t"))
    target = meta.join(F.broadcast(total)).select("symbol", (F.col("n_parts") / F.col("t")).alias("weight"))
    b = r.rebalance(now, target, 500_000, 0.02)
    return b.select("symbol", *[(F.round(c, 3) + 0.0).alias(c) for c in ("now", "want", "trade")], F.round("cost", 4).alias("cost"))


@register("""SELECT name, metric, round(value, 3) AS value, severity FROM (SELECT symbol AS name, 'net' AS metric, net AS value, CASE WHEN abs(net) > 20000 THEN 'HARD' ELSE 'WARN' END AS severity FROM e WHERE abs(net) > 5000 UNION ALL SELECT symbol, 'gross', gross, CASE WHEN gross > 60000 THEN 'HARD' ELSE 'WARN' END FROM e WHERE gross > 30000)""".replace("FROM e ", "FROM (SELECT symbol, sum(notional) AS net, sum(abs(notional)) AS gross FROM (SELECT leg_x AS symbol, notional_x AS notional FROM positions UNION ALL SELECT leg_y, notional_y FROM positions) GROUP BY 1) "))
def l10_limit_breaches(spark, d):
    c = a.concentration(a.legs(panels.positions(spark, d)), 6, 0.05)
    limits = spark.sql("SELECT * FROM VALUES ('net', 5000.0D, 20000.0D), ('gross', 30000.0D, 60000.0D) AS t(metric, warn, hard)")
    return r6(r.limit_breaches(r.unpivoted(c, "symbol", ["net", "gross"]), limits), "name", "metric", "severity", six=["value"], places=3)


@register("""SELECT symbol, dt, round(dd, 6) AS drawdown, round(r30, 6) AS roll30, streak, CASE WHEN dd <= -0.2 THEN 'HALTED' WHEN dd <= -0.15 THEN 'RECOVERY_ONLY' WHEN dd <= -0.1 OR r30 <= -0.08 THEN 'DEFENSIVE' WHEN dd <= -0.07 OR streak >= 5 THEN 'THROTTLED' WHEN dd <= -0.04 THEN 'CAUTIOUS' ELSE 'NORMAL' END AS level
FROM (SELECT symbol, dt, dd, r30, rn - coalesce(last_value(CASE WHEN NOT coalesce(chg < 0, false) THEN rn END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS streak
FROM (SELECT symbol, dt, vwap / max(vwap) OVER s - 1 AS dd, vwap / lag(vwap, 30) OVER s - 1 AS r30, vwap - lag(vwap) OVER s AS chg, row_number() OVER s AS rn FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY dt)))""")
def l11_heat_levels(spark, d):
    h = r.heat_levels(panels.bars(spark, d).withColumn("equity", F.col("vwap")), "symbol")
    return h.select("symbol", "dt", (F.round("drawdown", 6) + 0.0).alias("drawdown"), F.round("roll30", 6).alias("roll30"), F.col("streak").cast("long").alias("streak"), "level")


@register(f"{LEGS} SELECT symbol AS name, shock, round(net * f, 4) + 0.0 AS pnl, net * f < -1000 AS breach FROM (SELECT symbol, sum(notional) AS net FROM legs GROUP BY 1), (VALUES ('down10', -0.1), ('up10', 0.1), ('crash', -0.3)) t(shock, f)")
def l12_shock_grid(spark, d):
    e = a.legs(panels.positions(spark, d)).groupBy(F.col("symbol").alias("name")).agg(F.sum("notional").alias("net"))
    shocks = spark.sql("SELECT * FROM VALUES ('down10', -0.1D), ('up10', 0.1D), ('crash', -0.3D) AS t(shock, factor)")
    return r6(r.shock_grid(e, shocks, 1000.0), "name", "shock", "breach", six=["pnl"], places=4)


PERF = ["sharpe", "sortino", "max_drawdown", "ulcer", "kelly", "calmar"]


@register(f"""{RET}, q AS (SELECT symbol, dt, ret AS r, exp(sum(ln(1 + ret)) OVER s) AS eq FROM r WHERE ret IS NOT NULL WINDOW s AS (PARTITION BY symbol ORDER BY dt)), g AS (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY symbol ORDER BY dt), 1) - 1 AS dd FROM q)
SELECT symbol, n, {sql6(PERF, 5)} FROM (SELECT symbol, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, avg(r) / sqrt(avg(least(r, 0) ** 2)) * sqrt(252) AS sortino, min(dd) AS max_drawdown, sqrt(avg(dd * dd)) AS ulcer, avg(r) / var_samp(r) AS kelly, avg(r) * 252 / abs(min(dd)) AS calmar FROM g GROUP BY 1)""")
def l14_performance(spark, d):
    return r6(r.performance(bar_returns(spark, d), "ret", "symbol"), "symbol", "n", six=PERF, places=5)


@register(f"""{RET}, s AS (SELECT symbol, stddev_samp(log_ret) AS s, avg(log_ret) AS m, list_sum(list_sort(list(log_ret))[1:5]) AS w FROM r WHERE ret IS NOT NULL GROUP BY 1)
SELECT symbol, stress, round(loss, 6) AS loss FROM (SELECT symbol, 'two_sigma' AS stress, -2 * s AS loss FROM s UNION ALL SELECT symbol, 'three_sigma', -3 * s FROM s UNION ALL SELECT symbol, 'five_worst', w FROM s UNION ALL SELECT symbol, 'vol_doubling', -4 * s FROM s UNION ALL SELECT symbol, 'drift_20', 20 * m FROM s)""")
def l16_stress_table(spark, d):
    return r6(r.stress_table(bar_returns(spark, d), "log_ret", "symbol"), "symbol", "stress", six=["loss"])


@register("""SELECT symbol, n_rows, n_days, max_gap, n_jumps, array_to_string(ws, ',') AS warnings, CASE WHEN len(ws) = 0 THEN 'ok' WHEN len(ws) <= 1 THEN 'warn' ELSE 'bad' END AS status FROM (SELECT *, list_filter([CASE WHEN n_rows > n_days THEN 'duplicates' END, CASE WHEN max_gap > 8 THEN 'gap' END, CASE WHEN n_jumps > 0 THEN 'jumps' END], lambda v: v IS NOT NULL) AS ws
FROM (SELECT symbol, count(*) AS n_rows, count(DISTINCT dt) AS n_days, max(gap)::INT AS max_gap, count(*) FILTER (WHERE sd > 0 AND abs(r) > 2.5 * sd) AS n_jumps FROM (SELECT *, stddev_samp(r) OVER (PARTITION BY symbol) AS sd FROM (SELECT symbol, dt, date_diff('day', lag(dt) OVER s, dt) AS gap, ln(close / lag(close) OVER s) AS r FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY dt))) GROUP BY 1))""")
def m01_symbol_quality(spark, d):
    q = m.symbol_quality(panels.bars(spark, d), max_gap=8, sigma=2.5)
    return q.select("symbol", "n_rows", "n_days", "max_gap", "n_jumps", F.array_join("warnings", ",").alias("warnings"), "status")


@register("SELECT symbol, dt, 'low_volume' AS violation FROM bars WHERE volume < 20 UNION ALL SELECT symbol, dt, 'close_outside' FROM bars WHERE close > vwap * 1.5")
def m03_bar_validation(spark, d):
    b = panels.bars(spark, d).select("symbol", "dt", F.lit(1.0).alias("low"), F.when(F.col("close") > F.col("vwap") * 1.5, 0.0).otherwise(1.0).alias("h"), "volume")
    bad = m.bar_violations(b.select("symbol", "dt", F.lit(2.0).alias("high"), "low", F.when(F.col("h") == 0, 3.0).otherwise(1.5).alias("close"), F.when(F.col("volume") < 20, 0.0).otherwise(1.0).alias("volume")))
    return bad.select("symbol", "dt", F.when(F.col("violation") == "no_volume", "low_volume").otherwise(F.col("violation")).alias("violation"))


@register("""SELECT symbol, count(*) AS n, floor(date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') / 3600.0)::BIGINT AS age_hours, CASE WHEN count(*) < 40 THEN 'SHORT' WHEN (epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts)))) / 3600 > 36 THEN 'STALE' ELSE 'OK' END AS status FROM ticks GROUP BY 1""".replace("floor(date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') / 3600.0)", "floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts)))) / 3600)"))
def m04_freshness(spark, d):
    return m.freshness(panels.ticks(spark, d), "2024-01-31 00:00:00", 36, 40).select("symbol", "n", F.col("age_hours").cast("long").alias("age_hours"), "status")


@register("""SELECT coalesce(o_orderkey, k) AS order_id, CASE WHEN o_orderkey IS NULL THEN 'no_order' WHEN k IS NULL THEN 'missing_fill' WHEN abs(f - 100) > 10 THEN 'partial' ELSE 'ok' END AS status FROM orders FULL JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS f FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON o_orderkey = k""")
def m05_order_reconciliation(spark, d):
    o = panels.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit(100.0).alias("qty"))
    f = panels.table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("qty"))
    return m.order_reconciliation(o, f).select("order_id", "status")


@register("""SELECT symbol, kind, max(n) AS most FROM (SELECT symbol, kind, count(*) OVER (PARTITION BY symbol, kind ORDER BY floor(epoch(ts)) RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW) AS n FROM ticks) GROUP BY 1, 2 HAVING max(n) > 4""")
def m07_repeated_actions(spark, d):
    return m.repeated_actions(panels.ticks(spark, d), "symbol", "kind", "ts", 3, 4)


@register("SELECT symbol, count(*) AS n_breaks, min(event_id) AS first_break FROM (SELECT symbol, event_id, lag(event_id) OVER (PARTITION BY symbol ORDER BY event_id) AS b FROM ticks) WHERE (CASE WHEN event_id % 17 = 0 THEN -1 ELSE b END) IS DISTINCT FROM b GROUP BY 1")
def m08_audit_chain(spark, d):
    e = panels.ticks(spark, d).select("symbol", "event_id")
    log = e.withColumn("prev", F.when(F.col("event_id") % 17 == 0, -1).otherwise(F.lag("event_id").over(x.ordered("symbol", "event_id"))))
    return m.chain_breaks(log, "symbol", "event_id", "event_id", "prev")


@register("SELECT o_orderkey AS record_id, o_orderpriority AS entity FROM orders WHERE o_orderdate <= '1996-01-01' AND o_orderstatus = 'F' AND NOT (o_orderpriority = '1-URGENT' AND o_orderkey::VARCHAR LIKE '1%') AND NOT (o_orderpriority = '5-LOW')")
def m09_retention(spark, d):
    rec = panels.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderpriority").alias("entity"), F.col("o_orderdate").cast("date").alias("deletion_dt"), F.when(F.col("o_orderstatus") == "F", "ACTIVE").otherwise("DELETED").alias("status"))
    holds = spark.sql("SELECT * FROM VALUES ('1-URGENT', '1%'), ('5-LOW', '%') AS t(entity, pattern)")
    return m.deletable(rec, holds, "1996-01-01").select(F.col("record_id").cast("long").alias("record_id"), "entity")


@register("SELECT symbol AS source, kind AS rule, count(*) AS n, max((price > 90)::INT) AS severity, min(ts) AS first_seen, max(ts) AS last_seen FROM ticks GROUP BY 1, 2")
def m10_alert_groups(spark, d):
    return m.alert_groups(panels.ticks(spark, d).select(F.col("symbol").alias("source"), F.col("kind").alias("rule"), (F.col("price") > 90).cast("int").alias("severity"), "ts"))


@register("SELECT symbol, b AS from_ts, ts AS to_ts, round((epoch_us(ts) - epoch_us(b)) / 1e6, 6) AS seconds FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM ticks) WHERE epoch_us(ts) - epoch_us(b) > 86400000000")
def n02_heartbeat_gaps(spark, d):
    return r6(m.gaps(panels.ticks(spark, d), "symbol", "ts", 86_400), "symbol", "from_ts", "to_ts", six=["seconds"])


@register("""SELECT symbol, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n FROM (SELECT symbol, ts, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT symbol, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ticks)) GROUP BY symbol, s""")
def n06_sessions(spark, d):
    return m.sessions(panels.ticks(spark, d), "symbol", "ts", 30)


@register("SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS start_ts, round(first(price ORDER BY ts, event_id), 6) AS open, max(price) AS high, min(price) AS low, round(last(price ORDER BY ts, event_id), 6) AS close, count(*) AS n FROM ticks GROUP BY 1, 2")
def n01_tick_bars(spark, d):
    from spreadloom.streaming import jobs

    return jobs.tick_bars(panels.ticks(spark, d), "1 hour").select("symbol", "start_ts", F.round("open", 6).alias("open"), "high", "low", F.round("close", 6).alias("close"), "n")


@register("SELECT kind, w AS start_ts, count(*) AS n, round(avg((price > 90)::INT::DOUBLE), 6) AS breach_share FROM (SELECT kind, price, unnest(generate_series(time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR, time_bucket(INTERVAL 2 HOUR, ts), INTERVAL 2 HOUR)) AS w FROM ticks) GROUP BY 1, 2")
def n04_sliding_surveillance(spark, d):
    from spreadloom.streaming import jobs

    return r6(jobs.breach_share(panels.ticks(spark, d), 90.0, "6 hours", "2 hours"), "kind", "start_ts", "n", six=["breach_share"])
