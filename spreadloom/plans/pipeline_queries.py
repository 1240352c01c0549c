"""Queries of the composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.operators import aggregates as a
from spreadloom.operators import features as k
from spreadloom.operators import pairs as p
from spreadloom.operators import pipelines as pl
from spreadloom.operators import scoring as sc
from spreadloom.operators import sequential as s
from spreadloom.plans.job_queries import predictions, spread_z
from spreadloom.plans.pair_queries import HEDGE, pairs_of
from spreadloom.plans.registry import register
from spreadloom.plans.table_queries import FOLD_TABLE, LEGS, r6
from spreadloom.sources import panels

FACTORS = ["discount", "tax", "returned", "quantity"]


@register(""", l AS (SELECT dt, unnest(['discount', 'tax', 'returned', 'quantity']) AS factor, unnest([discount, tax, returned, quantity]) AS v FROM macro), f AS (SELECT factor, dt, v, v - lag(v, 26) OVER (PARTITION BY factor ORDER BY dt) AS momentum, count(v) OVER w AS n, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sp, stddev_samp(v) OVER w AS ss, list(v) OVER w AS fr FROM l WINDOW w AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
SELECT factor, dt, round(momentum, 6) + 0.0 AS momentum, CASE WHEN n = 26 THEN round((v - m) / nullif(sp, 0), 5) + 0.0 END AS z, CASE WHEN n = 26 THEN round(ss, 6) END AS vol, CASE WHEN n = 26 THEN round(m, 6) END AS mean, CASE WHEN n = 26 THEN round(len(list_filter(fr, lambda q: q <= v)) / 26.0, 6) END AS pct FROM f""")
def e32_macro_features(spark, d):
    f = pl.macro_features(panels.macro(spark, d), FACTORS, 26)
    return f.select("factor", "dt", (F.round("momentum", 6) + 0.0).alias("momentum"), (F.round("z", 5) + 0.0).alias("z"), *[F.round(c, 6).alias(c) for c in ("vol", "mean", "pct")])


@register("SELECT symbol, last_day(dt) AS month, round(last(close ORDER BY dt), 5) AS close, round(last(n ORDER BY dt), 5) AS n FROM (SELECT symbol, dt, close, NULL::DOUBLE AS n FROM bars UNION ALL SELECT symbol, dt, close, volume::DOUBLE FROM segs) GROUP BY 1, 2")
def a06_fundamentals_panel(spark, d):
    one = panels.bars(spark, d).select("symbol", "dt", F.col("close").cast("string").alias("close"))
    two = panels.segment_bars(spark, d).select("symbol", "dt", F.col("close").cast("string").alias("close"), F.col("volume").alias("n"))
    return r6(pl.fundamentals_panel([one, two], ["close", "n"]), "symbol", "month", six=["close", "n"], places=5)


def spreads(spark, d):
    x = pairs_of(spark, d)
    return p.spread(x, p.static_hedge(x))


@register(f"{HEDGE}, z AS (SELECT pair_id, dt, (spread - avg(spread) OVER q) / stddev_pop(spread) OVER q AS s FROM sp WINDOW q AS (PARTITION BY pair_id)), c AS (SELECT *, sum(s) OVER (PARTITION BY pair_id ORDER BY dt) AS c FROM z) SELECT pair_id, round((max(c) - min(c)) / sqrt(count(*)), 5) AS stat, CASE WHEN (max(c) - min(c)) / sqrt(count(*)) > 4 THEN 'CRITICAL' WHEN (max(c) - min(c)) / sqrt(count(*)) > 3 THEN 'MAJOR' WHEN (max(c) - min(c)) / sqrt(count(*)) > 1.63 THEN 'MINOR' ELSE 'NONE' END AS severity FROM c GROUP BY 1", "month")
def i11_structural_breaks(spark, d):
    return r6(pl.break_report(spreads(spark, d)), "pair_id", "severity", six=["stat"], places=5)


@register(f"""{HEDGE}, q AS (SELECT pair_id, dt, spread AS x, lag(spread) OVER o AS b, spread - lag(spread) OVER o AS c FROM sp WINDOW o AS (PARTITION BY pair_id ORDER BY dt)), f AS (SELECT pair_id, dt, count(x) OVER l AS n, stddev_samp(c) OVER s / nullif(stddev_samp(c) OVER l, 0) AS vol_ratio, regr_slope(x, b) OVER l AS ar1, abs((x - avg(x) OVER l) / stddev_pop(x) OVER l) AS abs_z, abs((avg(x) OVER s - avg(x) OVER l) / stddev_samp(x) OVER l) AS shift, row_number() OVER (PARTITION BY pair_id ORDER BY dt DESC) AS age
FROM q WINDOW s AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), l AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))
SELECT pair_id, round(vol_ratio, 5) AS vol_ratio, round(ar1, 5) AS ar1, round(abs_z, 5) AS abs_z, round(shift, 5) AS shift, CASE WHEN n < 36 OR vol_ratio IS NULL THEN 'UNKNOWN' WHEN shift > 2.5 THEN 'BROKEN' WHEN vol_ratio > 2 AND abs_z > 3 THEN 'CRISIS' WHEN ar1 > 0.97 THEN 'TRENDING' WHEN vol_ratio > 1.5 THEN 'HIGH_VOL' ELSE 'MEAN_REVERTING' END AS regime FROM f WHERE age = 1""", "month")
def i12_pair_regimes(spark, d):
    return r6(pl.regime_features(spreads(spark, d), short=12, long=36), "pair_id", "regime", six=["vol_ratio", "ar1", "abs_z", "shift"], places=5)


@register(f"""{HEDGE.split(', hedge AS')[0]}, r AS (SELECT pair_id, ln(x) AS lx, ln(y) AS ly, row_number() OVER (PARTITION BY pair_id ORDER BY dt DESC) AS age FROM px), g AS (SELECT pair_id, w, count(*) AS n, regr_slope(ly, lx) AS beta, avg(ly) AS my, avg(lx) AS mx, sqrt(greatest(var_samp(ly) - regr_slope(ly, lx) * covar_samp(ly, lx), 0)) AS sd, max(lx) FILTER (WHERE age = 1) AS x1, max(ly) FILTER (WHERE age = 1) AS y1 FROM r, (VALUES (24), (48)) t(w) WHERE age <= w GROUP BY 1, 2)
SELECT pair_id, w AS "window", round(beta, 5) AS beta, round((y1 - my - beta * (x1 - mx)) / nullif(sd, 0), 5) AS z, round(avg((y1 - my - beta * (x1 - mx)) / nullif(sd, 0)) OVER (PARTITION BY pair_id), 5) AS ensemble_z FROM g WHERE n = w""", "month")
def i29_fair_values(spark, d):
    return r6(pl.fair_values(pairs_of(spark, d), (24, 48)), "pair_id", "window", six=["beta", "z", "ensemble_z"], places=5)


@register()
def j03_candidates(spark, d):
    bars = panels.bars(spark, d, "month")
    return pl.candidates(bars, "vwap", 0.05, groups=sc.clusters(bars, 4))


@register()
def j04_discovery(spark, d):
    pairs = pairs_of(spark, d)
    verdicts = sc.validated(p.pair_metrics(pairs), s.pair_tests(pairs), p.hedge_stability(pairs, 8, 30), least_n=60, corr=0.1, low=0.1)
    return pl.decisions(j03_candidates(spark, d), verdicts, pl.regime_features(p.spread(pairs, p.static_hedge(pairs)), short=12, long=36))


@register()
def j19_walk_forward(spark, d):
    return pl.walk_forward(pairs_of(spark, d), spark.sql(FOLD_TABLE), 1.5, 0.5)


@register()
def k11_feature_selection(spark, d):
    z = k.z_features(spread_z(spark, d)).dropna()
    names = pl.uncorrelated(z, ["z", "z_abs", "z_mean", "z_std", "z_mom", "z_ar1"], 0.8)
    return z.select("pair_id", "dt", *names)


@register()
def k14_calibration(spark, d):
    return pl.calibrated(predictions(spark, d), "p", "y", F.pmod(F.xxhash64("pair", "p", "pnl"), F.lit(2)) == 0).select("pair", "p", "y", "calibrated")


@register()
def k14_calibration_quality(spark, d):
    """Errors of the raw score and of both calibrations on the rows that weren't fitted on."""
    rows, fit_on = predictions(spark, d), F.pmod(F.xxhash64("pair", "p", "pnl"), F.lit(2)) == 0
    raw = pl.calibration_errors(rows.where(~fit_on), "p", "y").withColumn("method", F.lit("none"))
    for method in ("isotonic", "sigmoid"):
        raw = raw.union(pl.calibration_errors(pl.calibrated(rows, "p", "y", fit_on, method), "calibrated", "y").withColumn("method", F.lit(method)))
    return raw


@register()
def k18_importance(spark, d):
    data = k.z_labels(k.z_features(spread_z(spark, d)), horizon=1, entry=1.0, fraction=0.25)
    return pl.importances(data, ["z_abs", "z_mean", "z_std", "z_ar1"], "reverts")


@register(f"{LEGS} SELECT round(sum(abs(notional)), 3) AS gross, round(sum(notional), 3) AS net, round(sum(abs(notional)) / 1000000, 6) AS leverage, count(DISTINCT pair) AS n_pairs, count(*) FILTER (WHERE notional > 0) AS n_long, count(*) FILTER (WHERE notional < 0) AS n_short FROM legs")
def l17_portfolio_kpis(spark, d):
    x = pl.portfolio_kpis(a.legs(panels.positions(spark, d)), 1_000_000)
    return x.select(F.round("gross", 3).alias("gross"), F.round("net", 3).alias("net"), F.round("leverage", 6).alias("leverage"), "n_pairs", "n_long", "n_short")
