"""Queries of the operators that assess scores, strategies and limits."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from spreadloom.functions.columns import ordered, ratio, so_far
from spreadloom.operators import assessment as s
from spreadloom.operators import pairs as p
from spreadloom.operators import tables as t
from spreadloom.operators import universe as u
from spreadloom.operators import windows as w
from spreadloom.operators.scoring import distance_score
from spreadloom.plans.job_queries import bar_returns
from spreadloom.plans.pair_queries import HEDGE, pairs_of
from spreadloom.plans.registry import register
from spreadloom.plans.table_queries import r6
from spreadloom.plans.window_queries import RET
from spreadloom.sources import panels

MOMENTS = RET + """, s AS (SELECT symbol, count(*) AS n, avg(log_ret) AS m, stddev_pop(log_ret) AS sp, avg(log_ret) / stddev_samp(log_ret) AS sr FROM r WHERE ret IS NOT NULL GROUP BY 1),
c AS (SELECT symbol, max(n) AS n, max(sr) AS sr, avg((log_ret - m) ** 3) / max(sp) ** 3 AS sk, avg((log_ret - m) ** 4) / max(sp) ** 4 - 3 AS ku FROM r JOIN s USING (symbol) WHERE ret IS NOT NULL GROUP BY 1)"""
Z10 = NormalDist().inv_cdf(1 - 0.05 / 10)


@register(f"""{MOMENTS}, v AS (SELECT *, CASE WHEN 1 - sk * sr + ku / 4 * sr * sr > 0 THEN 1 - sk * sr + ku / 4 * sr * sr ELSE 1 END AS v FROM c), x AS (SELECT *, sr / sqrt(v / (n - 1)) AS x FROM v)
SELECT symbol, n, round(1 - 1 / (1 + exp(-x * (1.5976 + 0.070565992 * x * x))), 6) + 0.0 AS p, round(greatest(1, 1 + v * ({Z10} / sr) ** 2) / 1000, 3) + 0.0 AS least_thousands, n >= 1 + v * ({Z10} / sr) ** 2 AS is_long_enough FROM x""")
def j17_track_record(spark, d):
    g = bar_returns(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), (F.avg("log_ret") / F.stddev_samp("log_ret")).alias("sr"), F.skewness("log_ret").alias("skew"), F.kurtosis("log_ret").alias("kurt"))
    x = s.sharpe_significance(g, 10).withColumn("least_thousands", F.col("least_n") / 1000)
    return x.select("symbol", "n", F.round("p", 6).alias("p"), F.round("least_thousands", 3).alias("least_thousands"), "is_long_enough")


@register("""SELECT trial_id, round(penalty, 6) + 0.0 AS penalty, round(least(greatest(k - 0.5 * penalty, 0), 100), 6) + 0.0 AS neutral FROM (SELECT trial_id, k, 20 * (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS penalty
FROM (SELECT trial_id, score / 20 AS k, abs(sharpe - 2) + abs(drawdown - 0.5) AS raw FROM trials))""")
def j09_factor_neutral(spark, d):
    x = panels.trials(spark, d).select("trial_id", (F.col("score") / 20).alias("score"), (F.col("sharpe") - 2).alias("value_exposure"), (F.col("drawdown") - 0.5).alias("size_exposure"))
    return r6(s.factor_neutral(x, "score", ["value_exposure", "size_exposure"]), "trial_id", six=["penalty", "neutral"])


@register(""", w AS (SELECT symbol, sector, n_parts / sum(n_parts) OVER ()::DOUBLE AS w FROM meta), a AS (SELECT *, sum(w) OVER (PARTITION BY sector = 'PROMO') AS g FROM w),
b AS (SELECT symbol, sector, CASE WHEN (SELECT coalesce(sum(w), 0) FROM w WHERE sector = 'PROMO') > 0.1 THEN CASE WHEN sector = 'PROMO' THEN w / g * 0.1 ELSE w / g * 0.9 END ELSE w END AS w FROM a),
c AS (SELECT *, sum(w) OVER (PARTITION BY sector = 'ECONOMY') AS g FROM b)
SELECT symbol, sector, round(CASE WHEN (SELECT coalesce(sum(w), 0) FROM b WHERE sector = 'ECONOMY') > 0.15 THEN CASE WHEN sector = 'ECONOMY' THEN w / g * 0.15 ELSE w / g * 0.85 END ELSE w END, 6) AS capped FROM c""")
def l06_caps_in_order(spark, d):
    weights = panels.meta(spark, d).select("symbol", "sector", F.col("n_parts").cast("double").alias("weight"))
    return r6(s.capped_in_order(weights, "sector", {"PROMO": 0.1, "ECONOMY": 0.15}), "symbol", "sector", six=["capped"])


def daily_pnl(spark, d):
    return panels.trades(spark, d).select("pair", F.col("entry").alias("dt"), "pnl")


PNL = ", pd AS (SELECT pair, entry AS dt, sum(pnl) AS pnl FROM trades GROUP BY 1, 2)"


@register(f"{PNL} SELECT pair, round(sum(pnl), 2) AS pnl, round(sum(pnl) / sum(sum(pnl)) OVER (), 6) + 0.0 AS share, round(avg(pnl) / stddev_samp(pnl), 6) + 0.0 AS info_ratio FROM pd GROUP BY 1")
def l07_pair_attribution(spark, d):
    x = s.pair_attribution(daily_pnl(spark, d))
    return r6(x.withColumn("pnl", F.round("pnl", 2)), "pair", "pnl", six=["share", "info_ratio"])


@register(f"""{PNL}, t AS (SELECT dt, sum(pnl) AS pnl FROM pd GROUP BY 1), c AS (SELECT *, sum(pnl) OVER (ORDER BY dt) AS cum FROM t), k AS (SELECT *, max(cum) OVER (ORDER BY dt) AS peak FROM c), q AS (SELECT *, max(CASE WHEN cum = peak THEN dt END) OVER (ORDER BY dt) AS peak_dt FROM k),
w AS (SELECT dt AS trough, peak_dt FROM q ORDER BY cum - peak, dt LIMIT 1), i AS (SELECT pair, dt, pnl FROM pd, w WHERE dt > peak_dt AND dt <= trough)
SELECT count(r) AS n_links, round(avg(r), 5) + 0.0 AS mean_corr FROM (SELECT corr(a.pnl, b.pnl) AS r FROM i a JOIN i b ON a.dt = b.dt AND a.pair < b.pair GROUP BY a.pair, b.pair HAVING count(*) >= 3)""")
def l07_drawdown_stress(spark, d):
    return r6(s.drawdown_stress(daily_pnl(spark, d)), "n_links", six=["mean_corr"], places=5)


Z95 = NormalDist().inv_cdf(0.95)


@register(f"""{RET}, w AS (SELECT symbol, n_parts / sum(n_parts) OVER ()::DOUBLE AS weight FROM meta), q AS (SELECT dt, sum(weight * ret) AS r FROM r JOIN w USING (symbol) WHERE ret IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(r) OVER (ORDER BY dt) AS cum FROM q),
k AS (SELECT *, cum - greatest(max(cum) OVER (ORDER BY dt), 0) AS dd FROM c) SELECT count(*) AS n, round(stddev_samp(r), 6) AS vol, round({Z95} * stddev_samp(r) - avg(r), 6) AS value_at_risk, round(min(dd), 6) + 0.0 AS max_drawdown, round(sum(r), 6) + 0.0 AS total FROM k""")
def l17_portfolio_risk(spark, d):
    meta = panels.meta(spark, d)
    whole = meta.agg(F.sum("n_parts").alias("all"))
    weights = meta.crossJoin(F.broadcast(whole)).select("symbol", (F.col("n_parts") / F.col("all")).alias("weight"))  # one row of totals
    return r6(s.portfolio_risk(weights, bar_returns(spark, d)), "n", six=["vol", "value_at_risk", "max_drawdown", "total"])


LABELS = ["risk_on", "risk_off", "stagflation", "reflation", "slowdown", "neutral"]
SIX = """, f AS (SELECT dt, (returned - avg(returned) OVER e) / nullif(stddev_pop(returned) OVER e, 0) AS r, (discount - avg(discount) OVER e) / nullif(stddev_pop(discount) OVER e, 0) AS g, (tax - avg(tax) OVER e) / nullif(stddev_pop(tax) OVER e, 0) AS i FROM macro WINDOW e AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT dt, CASE WHEN r < -0.5 OR (g < -0.4 AND i < 0) THEN 'risk_off' WHEN i > 0.4 AND g < 0 THEN 'stagflation' WHEN i > 0 AND g > 0.2 THEN 'reflation' WHEN g < -0.2 AND r <= 0.2 THEN 'slowdown' WHEN r > 0 THEN 'risk_on' ELSE 'neutral' END AS regime FROM f)"""


def factor_scores(spark, d):
    """(dt, risk, growth, inflation): z of three factors over their history so far."""
    long = panels.macro(spark, d).select("dt", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("risk", "returned"), ("growth", "discount"), ("inflation", "tax"))])))
    e = so_far("k")
    z = long.select("dt", "k", ratio(F.col("v") - F.avg("v").over(e), F.stddev_pop("v").over(e)).alias("z"))
    return z.groupBy("dt").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(k) for k in ("risk", "growth", "inflation")])


@register(f"{SIX} SELECT dt, regime, " + ", ".join(f"round(avg((regime = '{x}')::INT::DOUBLE) OVER w, 6) AS p_{x}" for x in LABELS) + " FROM l WINDOW w AS (ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def j21_market_regimes(spark, d):
    return r6(u.regime_probabilities(s.market_regimes(factor_scores(spark, d)), LABELS), "dt", "regime", six=[f"p_{x}" for x in LABELS])


RULES = "(VALUES ('mean_score', 45.0, true, 'WARN', 'search elsewhere'), ('share_worst', 0.3, false, 'CRITICAL', 'widen the tolerance'), ('spread', 42.0, false, 'INFO', 'split the study'))"


@register(f""", d AS (SELECT study_id, CASE WHEN sharpe <= 0.5 THEN 100 WHEN sharpe >= 3 THEN 0 ELSE 100 * (1 - ((sharpe - 0.5) / 2.5) ** 2) END::DOUBLE AS s FROM trials), g AS (SELECT study_id::VARCHAR AS run, unnest(['mean_score', 'share_worst', 'spread']) AS rule_id, unnest([avg(s), avg((s = 0)::INT::DOUBLE), stddev_samp(s)]) AS v FROM d GROUP BY 1)
SELECT run, rule_id, severity, advice, round(v, 5) AS value FROM g JOIN {RULES} k(rule_id, threshold, low_is_bad, severity, advice) USING (rule_id) WHERE CASE WHEN low_is_bad THEN v < threshold ELSE v >= threshold END""")
def j20_advice(spark, d):
    scored = panels.trials(spark, d).select("study_id", distance_score("sharpe", 0.5, 3.0, 2.0).alias("s"))
    runs = scored.groupBy("study_id").agg(F.avg("s").alias("mean_score"), F.avg((F.col("s") == 0).cast("double")).alias("share_worst"), F.stddev_samp("s").alias("spread"))
    long = runs.select(F.col("study_id").cast("string").alias("run"), F.inline(F.array(*[F.struct(F.lit(c).alias("rule_id"), F.col(c).alias("value")) for c in ("mean_score", "share_worst", "spread")])))
    rules = spark.sql(f"SELECT rule_id, CAST(threshold AS DOUBLE) AS threshold, low_is_bad, severity, advice FROM {RULES} AS k(rule_id, threshold, low_is_bad, severity, advice)")
    return t.rule_hits(long, rules).select("run", "rule_id", "severity", "advice", F.round("value", 5).alias("value"))


@register("""SELECT fold, count(*) FILTER (WHERE part = 'train' AND dt > DATE '1998-05-31') AS rows_after_end, abs(avg(close) FILTER (WHERE part = 'train') - avg(close) FILTER (WHERE part = 'test')) <= 0.02 * stddev_samp(close) FILTER (WHERE part = 'train') AND abs(stddev_samp(close) FILTER (WHERE part = 'test') - stddev_samp(close) FILTER (WHERE part = 'train')) <= 0.02 * stddev_samp(close) FILTER (WHERE part = 'train') AS scaled_together
FROM (SELECT close, dt, year(dt)::INT AS fold, CASE WHEN month(dt) <= 6 THEN 'train' ELSE 'test' END AS part FROM segs) GROUP BY 1""")
def k10_leakage_checks(spark, d):
    x = panels.segment_bars(spark, d).select("dt", "close", F.year("dt").alias("fold"), F.when(F.month("dt") <= 6, "train").otherwise("test").alias("part"))
    return s.leakage_checks(x, ["close"], "1998-05-31", 0.02)


@register(f"""{RET}, o AS (SELECT symbol, dt, log_ret AS x, (row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1) // 10 AS blk FROM r WHERE log_ret IS NOT NULL), g AS (SELECT *, sign(lag(x) OVER (PARTITION BY symbol, blk ORDER BY dt)) * x AS gain FROM o),
b AS (SELECT symbol, blk, count(*) AS m, coalesce(sum(gain), 0) AS i, arg_min(x, dt) AS f, arg_max(x, dt) AS l FROM g GROUP BY 1, 2),
e AS (SELECT b.*, rep, CASE WHEN rep = 0 THEN lpad(blk::VARCHAR, 12, '0') ELSE md5('42|' || symbol || '|' || rep || '|' || blk) END AS draw FROM b, range(0, 201) k(rep)),
j AS (SELECT *, sign(lag(l) OVER (PARTITION BY symbol, rep ORDER BY draw)) * f AS joint FROM e), q AS (SELECT symbol, rep, sum(m) AS n, (sum(i) + coalesce(sum(joint), 0)) / (sum(m) - 1) AS stat FROM j GROUP BY 1, 2)
SELECT a.symbol, max(a.n)::BIGINT AS n, round(max(a.stat), 8) + 0.0 AS observed, round(greatest(avg((c.stat >= a.stat - 1e-12)::INT::DOUBLE), 0.005), 6) AS p FROM q a JOIN q c ON a.symbol = c.symbol AND a.rep = 0 AND c.rep > 0 GROUP BY 1""")
def k20_block_permutation(spark, d):
    x = s.block_permutation(bar_returns(spark, d), "log_ret", "symbol", 200, 10)
    return x.select("symbol", "n", (F.round("observed", 8) + 0.0).alias("observed"), F.round("p", 6).alias("p"))


@register(""", m AS (SELECT symbol AS id, n_parts::DOUBLE AS a, price AS b, length(sector)::DOUBLE AS c FROM meta), l AS (SELECT id, unnest(['n_parts', 'price', 'letters']) AS metric, unnest([a, b, c]) AS v FROM m), z AS (SELECT id, metric, (v - avg(v) OVER k) / nullif(stddev_pop(v) OVER k, 0) AS v FROM l WINDOW k AS (PARTITION BY metric)),
j AS (SELECT z.id, z.metric, z.v, b.v AS b FROM z JOIN z b ON b.metric = z.metric AND b.id = 'Brand#1' AND z.id <> 'Brand#1'), q AS (SELECT *, v * b / nullif(sqrt(sum(v * v) OVER o) * sqrt(sum(b * b) OVER o), 0) AS c FROM j WINDOW o AS (PARTITION BY id))
SELECT id, metric, round(c, 6) + 0.0 AS contribution, round(sum(c) OVER (PARTITION BY id), 6) + 0.0 AS cosine FROM q""")
def j22_alignment(spark, d):
    m = panels.meta(spark, d).select("symbol", "n_parts", "price", F.length("sector").alias("letters"))
    return r6(s.aligned_with(m, "symbol", ["n_parts", "price", "letters"], "Brand#1"), "id", "metric", six=["contribution", "cosine"])


@register("SELECT symbol, dt, CASE WHEN count(*) OVER v = 12 THEN round(max(close) OVER v - min(close) OVER v, 4) END AS result FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def o02_window_map(spark, d):
    x = s.rolling_map(panels.bars(spark, d), "symbol", "close", 12, lambda m: m.max(1) - m.min(1))
    return x.select("symbol", "dt", F.round("result", 4).alias("result"))


@register("""SELECT symbol, dt, round(x, 6) + 0.0 AS x, reverts, CASE WHEN dt <= DATE '1997-06-30' THEN 'train' ELSE 'test' END AS part
FROM (SELECT symbol, dt, ln(close / lag(close) OVER o) AS x, lead(close, 4) OVER o > close AS reverts FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY dt)) WHERE reverts IS NOT NULL AND (dt <= DATE '1997-06-30' OR dt >= DATE '1997-08-01')""")
def k08_dataset(spark, d):
    b = panels.bars(spark, d)
    features = w.returns(b).select("symbol", "dt", F.col("log_ret").alias("x"))
    o = ordered("symbol")
    labels = b.select("symbol", "dt", (F.lead("close", 4).over(o) > F.col("close")).alias("reverts"))
    return r6(s.dataset(features, labels, ["symbol", "dt"], "reverts", "1997-06-30", "1997-08-01"), "symbol", "dt", "reverts", "part", six=["x"])


@register(f"{RET} SELECT symbol, min(dt) AS first_dt, max(dt) AS last_dt, count(*) AS n, round(avg(((close IS NULL)::INT + (ret IS NULL)::INT + 1) / 3.0::DOUBLE), 6) AS missing_share, 'yield' AS lacking FROM r GROUP BY 1")
def m12_field_coverage(spark, d):
    return r6(s.field_coverage(w.returns(panels.bars(spark, d)), "symbol", ["close", "ret", "yield"]), "symbol", "first_dt", "last_dt", "n", "lacking", six=["missing_share"])


@register(f"""{SIX}, v AS (SELECT dt, regime, abs(r) * 20 AS vix, (month(dt) % 4)::BIGINT AS breaches FROM l JOIN f USING (dt) WHERE r IS NOT NULL)
SELECT dt, round(greatest(0.005, 0.02 * CASE regime WHEN 'risk_off' THEN 0.7 WHEN 'risk_on' THEN 1.1 ELSE 1 END * CASE WHEN vix >= 40 THEN 0.6 WHEN vix >= 25 THEN 0.8 ELSE 1 END * CASE WHEN breaches > 0 THEN greatest(0.4, 1 - 0.1 * breaches) ELSE 1 END), 6) AS max_daily_loss,
round(greatest(0.5, 3.0 * CASE regime WHEN 'risk_off' THEN 0.7 WHEN 'risk_on' THEN 1.1 ELSE 1 END * CASE WHEN vix >= 40 THEN 0.5 WHEN vix >= 25 THEN 0.8 ELSE 1 END * CASE WHEN breaches > 0 THEN greatest(0.4, 1 - 0.1 * breaches) ELSE 1 END), 6) AS max_leverage FROM v""")
def l15_tightened_limits(spark, d):
    state = s.market_regimes(factor_scores(spark, d)).where("risk IS NOT NULL").withColumns({"vix": F.abs("risk") * 20, "breaches": F.month("dt") % 4})
    return r6(s.tightened_limits(state, 0.02, 3.0), "dt", six=["max_daily_loss", "max_leverage"])


@register(f"{RET} SELECT symbol, k.limits, count(*) FILTER (WHERE ret < -k.bound) AS n_breaches, max((ret < -k.bound)::INT) = 1 AS would_stop, round(min(ret), 6) AS worst FROM r, (VALUES ('old', 0.4::DOUBLE), ('new', 0.55::DOUBLE)) k(limits, bound) WHERE ret IS NOT NULL GROUP BY 1, 2, k.bound")
def l15_limits_what_if(spark, d):
    return r6(s.limits_what_if(bar_returns(spark, d), "symbol", "ret", {"old": 0.4, "new": 0.55}), "symbol", "limits", "n_breaches", "would_stop", six=["worst"])


@register("""SELECT symbol, dt, round(volume - last_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 90 DAYS PRECEDING), 6) + 0.0 AS momentum, round(stddev_samp(volume) OVER q, 6) + 0.0 AS deviation, count(volume) OVER q AS n
FROM bars WINDOW q AS (PARTITION BY symbol ORDER BY dt RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW)""")
def j07_score_momentum(spark, d):
    return r6(s.score_momentum(panels.bars(spark, d), "volume"), "symbol", "dt", "n", six=["momentum", "deviation"])


@register(f"""{HEDGE}, g AS (SELECT pair_id, dt, abs(spread - avg(spread) OVER e) AS gap, spread - lag(spread) OVER o AS chg FROM sp WINDOW o AS (PARTITION BY pair_id ORDER BY dt), e AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, stddev_samp(chg) OVER (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS vs, stddev_samp(chg) OVER (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS vl FROM g),
q AS (SELECT *, stddev_samp(vs) OVER (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS vv, last_value(gap) OVER (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lg FROM v)
SELECT pair_id, count(*) AS n, round(arg_max(vs, dt), 6) + 0.0 AS vol_short, round(arg_max(vl, dt), 6) + 0.0 AS vol_long, round(arg_max(vv, dt), 6) + 0.0 AS vol_of_vol, round(100 * avg((gap <= lg)::INT::DOUBLE), 4) AS gap_percentile FROM q GROUP BY 1""", "month")
def i12_spread_state(spark, d):
    x = pairs_of(spark, d)
    y = s.spread_state(p.spread(x, p.static_hedge(x)))
    return y.select("pair_id", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("vol_short", "vol_long", "vol_of_vol")], F.round("gap_percentile", 4).alias("gap_percentile"))
