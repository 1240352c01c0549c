"""Queries of operators that other queries use as parts: each on its own, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.operators import features as k
from spreadloom.operators import pairs as p
from spreadloom.operators import quality as m
from spreadloom.operators import risk as r
from spreadloom.operators import tables as t
from spreadloom.plans.job_queries import bar_returns
from spreadloom.plans.pair_queries import HEDGE, METRICS, RETS, pairs_of
from spreadloom.plans.registry import register
from spreadloom.plans.table_queries import RULES, r6
from spreadloom.plans.window_queries import RET
from spreadloom.sources import panels


@register(f"""{METRICS} SELECT pair_id, n_obs, round(corr, 6) AS corr FROM pm
WHERE n_obs >= 24 AND half_life BETWEEN 0.1 AND 120 AND corr < 0.999 AND spread_vol > 1e-8 AND spread_sharpe >= -10""", "month")
def b06_viable_pairs(spark, d):
    return r6(p.pair_metrics(pairs_of(spark, d)).where(p.is_viable(24, 0.1, 120, min_sharpe=-10.0)), "pair_id", "n_obs", six=["corr"])


@register(f"""{HEDGE}, mv AS (SELECT dt, discount - lag(discount) OVER o AS discount, tax - lag(tax) OVER o AS tax FROM mo WINDOW o AS (ORDER BY dt)),
l AS (SELECT dt, unnest(['discount', 'tax']) AS factor, unnest([discount, tax]) AS move FROM mv),
q AS (SELECT pair_id, dt, spread - lag(spread) OVER (PARTITION BY pair_id ORDER BY dt) AS d FROM sp)
SELECT pair_id, factor, count(*) AS n, round(corr(d, move), 6) + 0.0 AS corr, round(regr_slope(d, move), 6) + 0.0 AS beta FROM q JOIN l USING (dt) WHERE d IS NOT NULL AND move IS NOT NULL GROUP BY 1, 2""".replace(", mv AS", ", mo AS (SELECT date_trunc('month', l_shipdate)::DATE AS dt, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1), mv AS"), "month")
def c10_pair_factor_links(spark, d):
    pairs = pairs_of(spark, d)
    lines = panels.table(spark, d, "lineitem")
    monthly = lines.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("dt")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return r6(p.factor_links(p.spread(pairs, p.static_hedge(pairs)), monthly, ["discount", "tax"]), "pair_id", "factor", "n", six=["corr", "beta"])


@register(f"""{RET}, j AS (SELECT r.symbol, r.log_ret AS a, b.b FROM r JOIN (SELECT dt, avg(log_ret) AS b FROM r WHERE ret IS NOT NULL GROUP BY 1) b USING (dt) WHERE ret IS NOT NULL),
h AS (SELECT leg_x AS symbol, sum(notional_x) AS notional FROM positions GROUP BY 1)
SELECT symbol, round(beta, 6) AS beta, round(notional, 4) AS notional, round(-beta * notional, 4) + 0.0 AS hedge FROM (SELECT symbol, regr_slope(a, b) AS beta FROM j GROUP BY 1) JOIN h USING (symbol)""")
def d19_neutral_notional(spark, d):
    one = bar_returns(spark, d)
    beta = r.against_benchmark(one.join(one.groupBy("dt").agg(F.avg("log_ret").alias("bench")), "dt"), "log_ret", "bench", "symbol")
    held = panels.positions(spark, d).groupBy(F.col("leg_x").alias("symbol")).agg(F.sum("notional_x").alias("notional"))
    j = beta.join(held, "symbol")
    return j.select("symbol", F.round("beta", 6).alias("beta"), F.round("notional", 4).alias("notional"), (F.round(-F.col("beta") * F.col("notional"), 4) + 0.0).alias("hedge"))


WEIGHTS = ["equal", "inverse_vol", "score_tilt", "conviction", "vol_target"]


@register(f"""{RET}, v AS (SELECT symbol, stddev_samp(log_ret) AS vol, avg(log_ret) AS score FROM r GROUP BY 1), w AS (SELECT *, greatest(score, 0) AS g FROM v WHERE vol > 0 AND score IS NOT NULL)
SELECT symbol, round(1.0::DOUBLE / count(*) OVER a, 6) AS equal, round(1 / vol / sum(1 / vol) OVER a, 6) AS inverse_vol, round(g / nullif(sum(g) OVER a, 0), 6) AS score_tilt, round(g / vol / nullif(sum(g / vol) OVER a, 0), 6) AS conviction,
  round(0.1 / sqrt(sum(vol * vol) OVER a), 6) AS vol_target FROM w WINDOW a AS ()""")
def l05_weight_schemes(spark, d):
    stats = bar_returns(spark, d).groupBy("symbol").agg(F.stddev_samp("log_ret").alias("vol"), F.avg("log_ret").alias("score"))
    return r6(r.weight_schemes(stats, 0.1), "symbol", six=WEIGHTS)


@register("""SELECT study_id, count(*) AS received, count(*) FILTER (WHERE state = 'COMPLETE') AS ranked, count(*) FILTER (WHERE state = 'COMPLETE' AND sharpe >= 2 AND drawdown <= 0.5) AS funded,
  round(coalesce(sum(score) FILTER (WHERE state = 'COMPLETE' AND sharpe >= 2 AND drawdown <= 0.5), 0), 4) AS capital, count(*) FILTER (WHERE state = 'COMPLETE' AND sharpe < 2) AS low_sharpe, count(*) FILTER (WHERE state = 'COMPLETE' AND sharpe >= 2 AND drawdown > 0.5) AS deep_drawdown
FROM trials GROUP BY 1""")
def l13_funnel(spark, d):
    done, good, safe = F.col("state") == "COMPLETE", F.col("sharpe") >= 2, F.col("drawdown") <= 0.5
    funded = done & good & safe
    f = panels.trials(spark, d).groupBy("study_id").agg(
        F.count("*").alias("received"), F.count_if(done).alias("ranked"), F.count_if(funded).alias("funded"), F.coalesce(F.sum(F.when(funded, F.col("score"))), F.lit(0.0)).alias("capital"),
        F.count_if(done & ~good).alias("low_sharpe"), F.count_if(done & good & ~safe).alias("deep_drawdown"),
    )
    return f.withColumn("capital", F.round("capital", 4))


@register(f"""{RETS}, c AS (SELECT pair_id, sym_x, sym_y, corr(rx, ry) AS corr FROM pr GROUP BY 1, 2, 3),
days AS (SELECT pair_id, dt, count(*) AS legs FROM (SELECT DISTINCT pair_id, sym_x, sym_y FROM px) JOIN bars ON symbol IN (sym_x, sym_y) GROUP BY 1, 2), o AS (SELECT pair_id, count(*) FILTER (WHERE legs = 2) / count(*)::DOUBLE AS overlap FROM days GROUP BY 1),
q AS (SELECT *, stddev_samp(r) OVER (PARTITION BY symbol) AS sd FROM (SELECT symbol, dt, close, volume, date_diff('day', lag(dt) OVER s, dt) AS gap, ln(close / lag(close) OVER s) AS r FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY dt))),
st AS (SELECT symbol, (count(*) > count(DISTINCT dt))::INT + (avg((close IS NULL)::INT::DOUBLE) > 0.05)::INT + (avg((volume = 0)::INT::DOUBLE) > 0.05)::INT + (coalesce(max(gap), 0) > 40)::INT + (count(*) FILTER (WHERE sd > 0 AND abs(r) > 4 * sd) > 0)::INT AS n FROM q GROUP BY 1),
w AS (SELECT c.pair_id, overlap, corr, (coalesce(overlap, 0) < 0.5)::INT + (coalesce(abs(corr), 0) < 0.2)::INT + (x.n > 1)::INT + (y.n > 1)::INT AS n FROM c LEFT JOIN o USING (pair_id) JOIN st x ON x.symbol = sym_x JOIN st y ON y.symbol = sym_y)
SELECT pair_id, round(overlap, 6) AS overlap, round(corr, 6) AS corr, n::INT AS n_warnings, CASE n WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'bad' END AS status FROM w""", "month")
def m02_pair_quality(spark, d):
    series, pairs = panels.bars(spark, d, "month"), pairs_of(spark, d)
    listed = pairs.select("pair_id", "sym_x", "sym_y").distinct()
    overlap = p.day_overlap(series, listed).select("pair_id", "overlap")
    found = p.pair_quality(overlap, p.pair_correlation(pairs).select("pair_id", "sym_x", "sym_y", "corr"), m.symbol_quality(series, max_gap=40).select("symbol", "status"))
    return r6(found, "pair_id", "n_warnings", "status", six=["overlap", "corr"])


@register(f"""SELECT rule_id, symbol, severity, count(*) AS n, round(max(abs(price - threshold)), 6) AS worst, min(ts)::DATE AS first_day FROM ticks JOIN {RULES} r(rule_id, threshold, low_is_bad, severity) ON kind = rule_id
WHERE CASE WHEN low_is_bad THEN price < threshold ELSE price >= threshold END GROUP BY 1, 2, 3""")
def m06_surveillance_events(spark, d):
    rules = spark.sql(f"SELECT * FROM {RULES} AS r(rule_id, threshold, low_is_bad, severity)")
    hits = t.rule_hits(panels.ticks(spark, d).select(F.col("kind").alias("rule_id"), "symbol", "ts", F.col("price").alias("value")), rules)
    return hits.groupBy("rule_id", "symbol", "severity").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("value") - F.col("threshold"))), 6).alias("worst"), F.min("ts").cast("date").alias("first_day"))


@register("""SELECT study_id AS run, state AS stage, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(sharpe), 6) AS best_sharpe, min(trial_id) AS first_trial, max(trial_id) AS last_trial FROM trials GROUP BY 1, 2""")
def m11_run_summaries(spark, d):
    g = panels.trials(spark, d).groupBy(F.col("study_id").alias("run"), F.col("state").alias("stage"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("sharpe"), 6).alias("best_sharpe"), F.min("trial_id").alias("first_trial"), F.max("trial_id").alias("last_trial"))


FOLD_SQL = """, k AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS k FROM (SELECT DISTINCT dt FROM bars)), s AS (SELECT unnest(generate_series(0, (SELECT max(k) FROM k) + 1 - 190, 30)) AS start)
SELECT (start // 30)::INT AS fold, a.dt AS train_start, b.dt AS train_end, c.dt AS test_start, e.dt AS test_end FROM s JOIN k a ON a.k = {first} JOIN k b ON b.k = start + 149 JOIN k c ON c.k = start + 160 JOIN k e ON e.k = start + 189"""


@register(FOLD_SQL.format(first="start"))
def k09_sliding_folds(spark, d):
    return k.rolling_folds(panels.bars(spark, d), 150, 30, 10)


@register(FOLD_SQL.format(first="0"))
def k09_expanding_folds(spark, d):
    return k.rolling_folds(panels.bars(spark, d), 150, 30, 10, expanding=True)
