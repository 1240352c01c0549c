"""Queries of the operators that follow a series or solve a small system, of scoring, and of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spreadloom.functions import columns as x
from spreadloom.operators import pairs as p
from spreadloom.operators import risk as r
from spreadloom.operators import scoring as sc
from spreadloom.operators import sequential as s
from spreadloom.operators import windows as w
from spreadloom.operators.warping import nearest_by_warping
from spreadloom.plans.job_queries import SPZ, spread_z
from spreadloom.plans.pair_queries import PAIRS, RETS, pairs_of
from spreadloom.plans.registry import register
from spreadloom.plans.table_queries import r6
from spreadloom.plans.window_queries import EWMA, RET, TWO, ZSQL, bar_z, segment_pairs
from spreadloom.sources import panels


@register(""", n AS MATERIALIZED (SELECT symbol, dt, coalesce(close - lag(close) OVER o, 0) AS d, row_number() OVER o AS k FROM segs WINDOW o AS (PARTITION BY symbol ORDER BY dt)),
c AS (SELECT symbol, dt, k, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q FROM n WHERE k = 1
  UNION ALL SELECT symbol, dt, k, up, down, CASE WHEN up > 200000 OR down > 200000 THEN 0 ELSE up END, CASE WHEN up > 200000 OR down > 200000 THEN 0 ELSE down END
  FROM (SELECT n.symbol, n.dt, n.k, greatest(0, c.p + n.d - 1000) AS up, greatest(0, c.q - n.d - 1000) AS down FROM c JOIN n ON n.symbol = c.symbol AND n.k = c.k + 1))
SELECT symbol, dt, round(up, 5) + 0.0 AS up, round(down, 5) + 0.0 AS down, CASE WHEN up > 200000 THEN 1 WHEN down > 200000 THEN -1 ELSE 0 END AS alarm FROM c""", recursive=True)
def e12_cusum_chart(spark, d):
    return r6(s.cusum_chart(panels.segment_bars(spark, d), "close", 200_000.0, 1_000.0), "symbol", "dt", "alarm", six=["up", "down"], places=5)


@register(f""", n AS (SELECT symbol, dt, close, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS k FROM bars),
r AS (SELECT a.symbol, a.dt, any_value(a.close) - sum(b.close * {EWMA}) AS r FROM n a JOIN n b ON a.symbol = b.symbol AND b.k <= a.k GROUP BY 1, 2)
SELECT symbol, dt, CASE WHEN count(r) OVER w = 26 THEN round((r - avg(r) OVER w) / nullif(stddev_pop(r) OVER w, 0), 6) + 0.0 END AS z FROM r WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""")
def e16_ewma_residual_z(spark, d):
    return r6(s.ewma_residual_z(panels.bars(spark, d), "close", 12, 26).replace(float("nan"), None), "symbol", "dt", six=["z"])


@register(f"""{RETS}, n AS (SELECT pair_id, dt, rx, ry, row_number() OVER (PARTITION BY pair_id ORDER BY dt) AS k FROM pr WHERE rx IS NOT NULL AND ry IS NOT NULL),
m AS (SELECT a.pair_id, a.dt, sum(b.rx * b.rx * {EWMA}) AS xx, sum(b.ry * b.ry * {EWMA}) AS yy, sum(b.rx * b.ry * {EWMA}) AS xy FROM n a JOIN n b ON a.pair_id = b.pair_id AND b.k <= a.k GROUP BY 1, 2)
SELECT pair_id, dt, round(sqrt(xx), 6) AS vol_x, round(sqrt(yy), 6) AS vol_y, round(xy, 6) + 0.0 AS cov, round(xy / sqrt(xx * yy), 6) + 0.0 AS corr FROM m""", "month")
def e09_ewma_moments(spark, d):
    o = x.ordered("pair_id")
    step = lambda c: F.ln(c) - F.lag(F.ln(c)).over(o)
    r = pairs_of(spark, d).select("pair_id", "dt", step("x").alias("rx"), step("y").alias("ry"))
    return r6(w.ewma_moments(r, 12), "pair_id", "dt", six=["vol_x", "vol_y", "cov", "corr"])


#: Autocorrelations r by symbol and lag.
ACF = """, e AS (SELECT symbol, dt, close - avg(close) OVER (PARTITION BY symbol) AS e, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS k FROM bars),
acf AS (SELECT a.symbol, b.k - a.k AS lag, sum(a.e * b.e) AS s FROM e a JOIN e b ON a.symbol = b.symbol AND b.k - a.k BETWEEN 0 AND {n} GROUP BY 1, 2),
r AS (SELECT symbol, lag, s / first_value(s) OVER (PARTITION BY symbol ORDER BY lag) AS r FROM acf)"""


@register(f"""{ACF.format(n=5)}, l AS (SELECT symbol, list(r ORDER BY lag) AS r FROM r GROUP BY 1),
p AS (SELECT symbol, r, 1 AS k, [r[2]] AS phi, r[2] AS a FROM l UNION ALL
  SELECT symbol, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - b * phi[k + 1 - j]), b), b
  FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS b FROM p WHERE k < 5))
SELECT symbol, k AS lag, round(a, 6) + 0.0 AS pacf FROM p""", recursive=True)
def e19_pacf(spark, d):
    return r6(s.pacf(panels.bars(spark, d), "close", 5).select("symbol", F.posexplode("pacf").alias("at", "pacf")).withColumn("lag", F.col("at") + 1), "symbol", "lag", six=["pacf"])


@register(f"""{RET}, n AS (SELECT symbol, dt, log_ret AS v, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS k FROM r),
f AS (SELECT a.symbol, a.dt, b.v, min(b.v) OVER g AS lo, max(b.v) OVER g AS hi, count(b.v) OVER g AS n FROM n a JOIN n b ON a.symbol = b.symbol AND b.k BETWEEN a.k - 39 AND a.k WINDOW g AS (PARTITION BY a.symbol, a.dt)),
h AS (SELECT symbol, dt, CASE WHEN hi > lo THEN least(9, floor((v - lo) / (hi - lo) * 10)) ELSE 5 END AS bin, count(*) AS c FROM f WHERE n = 40 GROUP BY 1, 2, 3),
e AS (SELECT symbol, dt, -sum(c / 40.0::DOUBLE * ln(c / 40.0::DOUBLE)) AS entropy FROM h GROUP BY 1, 2)
SELECT symbol, dt, round(entropy, 6) + 0.0 AS entropy FROM bars LEFT JOIN e USING (symbol, dt)""")
def e20_rolling_entropy(spark, d):
    return r6(s.rolling_entropy(w.returns(panels.bars(spark, d)), "log_ret", 40).replace(float("nan"), None), "symbol", "dt", six=["entropy"])


@register(f"""{SPZ}, t AS MATERIALIZED (SELECT pair_id, dt, z, row_number() OVER (PARTITION BY pair_id ORDER BY dt) AS k FROM zs WHERE z IS NOT NULL),
w AS (SELECT pair_id, NULL::DATE AS dt, 0::BIGINT AS k, 0 AS dir, 0 AS held, 0.0::DOUBLE AS ez, NULL::VARCHAR AS event, 0 AS direction, 0.0::DOUBLE AS pnl_z FROM t WHERE k = 1 UNION ALL
  SELECT pair_id, dt, k, CASE WHEN opens THEN -sign(z)::INT WHEN why IS NOT NULL THEN 0 ELSE dir END, CASE WHEN dir = 0 OR why IS NOT NULL THEN 0 ELSE held + 1 END, CASE WHEN opens THEN z ELSE ez END,
    CASE WHEN opens THEN 'OPEN' ELSE why END, CASE WHEN opens THEN -sign(z)::INT ELSE dir END, CASE WHEN opens THEN 0 ELSE dir * (z - ez) END
  FROM (SELECT t.pair_id, t.dt, t.k, t.z, w.dir, w.held, w.ez, w.dir = 0 AND abs(t.z) >= 1.5 AND abs(t.z) < 4 AS opens,
      CASE WHEN w.dir <> 0 THEN CASE WHEN abs(t.z) >= 4 THEN 'STOP' WHEN abs(t.z) <= 0.5 THEN 'EXIT' WHEN w.held + 1 >= 12 THEN 'TIME' END END AS why FROM w JOIN t ON t.pair_id = w.pair_id AND t.k = w.k + 1))
SELECT pair_id, dt, event, direction, round(pnl_z, 5) + 0.0 AS pnl_z FROM w WHERE event IS NOT NULL""", "month", recursive=True)
def e27_trade_episodes(spark, d):
    return r6(s.trade_episodes(spread_z(spark, d), 1.5, 0.5, 4.0, 12), "pair_id", "dt", "event", "direction", six=["pnl_z"], places=5)


@register(f"{ZSQL} SELECT symbol, count(*) AS n, round(quantile_cont(abs(z), 0.9), 6) AS entry, round(quantile_cont(abs(z), 0.3), 6) AS exit FROM zz WHERE z IS NOT NULL GROUP BY 1")
def e33_threshold_quantiles(spark, d):
    return r6(w.threshold_quantiles(bar_z(spark, d), "z", 0.9, 0.3), "symbol", "n", six=["entry", "exit"])


@register(""", l AS (SELECT symbol, list(close) AS xs, last(close ORDER BY dt) AS latest, median(close) AS loc FROM bars GROUP BY 1 HAVING count(*) >= 3),
m AS (SELECT *, 1.4826 * list_median(list_transform(xs, lambda v: abs(v - loc))) AS scale FROM l),
h AS (SELECT symbol, xs, latest, scale, loc, 0 AS step, false AS done FROM m WHERE scale > 0 UNION ALL
  SELECT symbol, xs, latest, scale, next, step + 1, abs(next - loc) < 1e-9 * scale
  FROM (SELECT *, list_sum(list_transform(xs, lambda v: v * least(1, 1.345 * scale / greatest(abs(v - loc), 1e-300)))) / list_sum(list_transform(xs, lambda v: least(1, 1.345 * scale / greatest(abs(v - loc), 1e-300)))) AS next FROM h WHERE step < 25 AND NOT done))
SELECT s.symbol, round((latest - loc) / scale, 5) + 0.0 AS huber_z FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY step DESC) AS k FROM h) h ON s.symbol = h.symbol AND k = 1""", recursive=True)
def e33_huber_z(spark, d):
    return r6(s.huber_z(panels.bars(spark, d), "close"), "symbol", six=["huber_z"], places=5)


@register()
def i03_pair_tests(spark, d):
    """Unit root with lags, Engle-Granger, Johansen, KPSS and Hurst of every pair."""
    return s.pair_tests(pairs_of(spark, d))


@register(f"""{TWO}, n AS MATERIALIZED (SELECT pair_id, dt, ln(x) AS x, ln(y) AS y, row_number() OVER (PARTITION BY pair_id ORDER BY dt) AS k FROM two),
f AS (SELECT pair_id, NULL::DATE AS dt, 0::BIGINT AS k, 1.0::DOUBLE AS beta, 0.0::DOUBLE AS alpha, 0.0::DOUBLE AS error, 1.0::DOUBLE AS p, 0.0::DOUBLE AS q, 1.0::DOUBLE AS r FROM n WHERE k = 1 UNION ALL
  SELECT pair_id, dt, k, beta + u / s * e, alpha + v / s * e, e, p - u / s * u, q - u / s * v, r - v / s * v
  FROM (SELECT *, x - (y * beta + alpha) AS e, y * u + v + 1e-3 AS s
    FROM (SELECT n.pair_id, n.dt, n.k, n.x, n.y, f.beta, f.alpha, f.p + 1e-4 AS p, f.q, f.r + 1e-4 AS r, n.y * (f.p + 1e-4) + f.q AS u, n.y * f.q + f.r + 1e-4 AS v FROM f JOIN n ON n.pair_id = f.pair_id AND n.k = f.k + 1)))
SELECT pair_id, dt, round(beta, 5) + 0.0 AS beta, round(alpha, 5) + 0.0 AS alpha, round(error, 5) + 0.0 AS error FROM f WHERE k > 0""", recursive=True)
def i09_kalman_hedge(spark, d):
    return r6(s.kalman_hedge(segment_pairs(spark, d)), "pair_id", "dt", six=["beta", "alpha", "error"], places=5)


@register()
def i10_validation_verdict(spark, d):
    pairs = pairs_of(spark, d)
    ratios = p.variance_ratio(p.spread(pairs, p.static_hedge(pairs)))
    return sc.validated(p.pair_metrics(pairs), s.pair_tests(pairs), p.hedge_stability(pairs, 8, 30), least_n=60, ratios=ratios)


@register(f"""{PAIRS}, dist AS (SELECT a.pair_id, a.dt AS i, b.dt AS j, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM px a JOIN px b ON a.pair_id = b.pair_id),
c AS (SELECT pair_id, dx - avg(dx) OVER ri - avg(dx) OVER cj + avg(dx) OVER g AS a, dy - avg(dy) OVER ri - avg(dy) OVER cj + avg(dy) OVER g AS b FROM dist
  WINDOW ri AS (PARTITION BY pair_id, i), cj AS (PARTITION BY pair_id, j), g AS (PARTITION BY pair_id))
SELECT pair_id, round(CASE WHEN avg(a * a) * avg(b * b) > 0 THEN sqrt(greatest(0, avg(a * b)) / sqrt(avg(a * a) * avg(b * b))) END, 5) AS dcor FROM c GROUP BY 1""", "month")
def i15_distance_correlation(spark, d):
    return r6(s.distance_correlation(pairs_of(spark, d)), "pair_id", six=["dcor"], places=5)


@register()
def i16_granger(spark, d):
    return s.granger(pairs_of(spark, d))


@register()
def i18_spectrum(spark, d):
    return s.spectrum(panels.bars(spark, d), "close")


@register()
def i19_time_warping(spark, d):
    return s.time_warping(pairs_of(spark, d))


@register()
def i20_sample_entropy(spark, d):
    return s.sample_entropy(panels.bars(spark, d), "close")


@register()
def i26_mahalanobis(spark, d):
    return s.mahalanobis(panels.macro(spark, d).withColumn("book", F.lit("macro")), ["discount", "tax", "returned", "quantity"], 52)


@register(f"""{ACF.format(n=10)}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1), q AS (SELECT symbol, any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)) AS q FROM r JOIN n USING (symbol) WHERE lag > 0 GROUP BY 1)
SELECT symbol, round(q, 5) AS q, round(least(1, exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24)), 5) AS p FROM q""")
def i33_ljung_box(spark, d):
    return r6(s.ljung_box(panels.bars(spark, d), "close", 10), "symbol", six=["q", "p"], places=5)


FACT = "unnest(['discount', 'tax', 'returned', 'quantity']) AS factor, unnest([discount, tax, returned, quantity]) AS v"


@register(f""", l AS (SELECT dt, {FACT} FROM macro), c AS (SELECT factor, dt, k, v - lag(v, k) OVER (PARTITION BY factor, k ORDER BY dt) AS chg FROM l, (VALUES (1), (4)) t(k)), z AS (SELECT *, chg / stddev_samp(chg) OVER (PARTITION BY factor, k) AS z FROM c)
SELECT factor, dt, k, round(z, 6) AS z, place FROM (SELECT *, row_number() OVER (PARTITION BY factor, k ORDER BY abs(z) DESC, dt) AS place FROM z WHERE abs(z) >= 2.5) WHERE place <= 20""")
def j15_macro_shocks(spark, d):
    return r6(sc.macro_shocks(panels.macro(spark, d), ["discount", "tax", "returned", "quantity"], (1, 4), 2.5, 20), "factor", "dt", "k", "place", six=["z"])


@register(""", z AS (SELECT dt, (discount - avg(discount) OVER e) / nullif(stddev_pop(discount) OVER e, 0) AS g, (tax - avg(tax) OVER e) / nullif(stddev_pop(tax) OVER e, 0) AS i FROM macro WINDOW e AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT dt, round(g, 6) AS growth_z, round(i, 6) AS inflation_z, CASE WHEN g IS NULL OR i IS NULL THEN 'unknown' WHEN g > 0.5 AND i <= 0.5 THEN 'growth' WHEN g < -0.5 AND i > 0.5 THEN 'stagflation' WHEN i > 0.5 THEN 'inflation' WHEN g < -0.5 THEN 'recession' ELSE 'neutral' END AS regime FROM z""")
def j14_macro_regimes(spark, d):
    return r6(sc.macro_regimes(panels.macro(spark, d), "discount", "tax"), "dt", "regime", six=["growth_z", "inflation_z"])


@register(""", h AS (SELECT symbol, dt, close, max(dt) OVER (PARTITION BY symbol) AS last_dt, last(close) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_v FROM bars)
SELECT symbol, days, round(100 * avg((close <= last_v)::INT::DOUBLE), 6) AS percentile FROM h, (VALUES (365), (1095), (3650)) t(days) WHERE date_diff('day', dt, last_dt) <= days GROUP BY 1, 2""")
def j08_horizon_percentiles(spark, d):
    return r6(sc.horizon_percentiles(panels.bars(spark, d), "close", (365, 1095, 3650)), "symbol", "days", six=["percentile"])


@register("SELECT 'sector' AS dim, sector AS name, count(*) AS n, round(avg(price), 6) AS mean FROM meta GROUP BY 2 UNION ALL SELECT 'tag', tag, count(*), round(avg(price), 6) FROM (SELECT price, unnest(string_split(lower(sector) || ' ' || CASE WHEN n_parts >= 80 THEN 'large' ELSE 'small' END, ' ')) AS tag FROM meta) GROUP BY 2")
def j12_group_statistics(spark, d):
    meta = panels.meta(spark, d).withColumn("tags", F.split(F.concat_ws(" ", F.lower("sector"), F.when(F.col("n_parts") >= 80, "large").otherwise("small")), " "))
    return r6(sc.group_statistics(meta, "price"), "dim", "name", "n", six=["mean"])


@register(""", f AS (SELECT symbol, count(*)::DOUBLE AS n, avg(close) AS m, stddev_samp(close) AS s, avg(volume) AS v FROM bars GROUP BY 1), l AS (SELECT symbol, unnest(['n', 'm', 's', 'v']) AS k, unnest([n, m, s, v]) AS v FROM f), z AS (SELECT symbol, k, (v - avg(v) OVER (PARTITION BY k)) / nullif(stddev_pop(v) OVER (PARTITION BY k), 0) AS v FROM l)
SELECT a.symbol AS a, b.symbol AS b, round((sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)), 0) + 1) / 2, 6) AS cosine, round(1 / (1 + sqrt(sum((a.v - b.v) ** 2))), 6) AS euclid FROM z a JOIN z b ON a.k = b.k AND a.symbol < b.symbol GROUP BY 1, 2""")
def j13_profile_similarity(spark, d):
    f = panels.bars(spark, d).groupBy("symbol").agg(F.count("*").cast("double").alias("n"), F.avg("close").alias("m"), F.stddev_samp("close").alias("s"), F.avg("volume").alias("v"))
    return r6(sc.similarity(f, "symbol", ["n", "m", "s", "v"]), "a", "b", six=["cosine", "euclid"])


@register(""", t AS (SELECT symbol, 2 * (1 - x) AS p FROM (SELECT symbol, 0.5 + 0.45 * tanh(abs(avg(close) - 50000) / stddev_samp(close)) AS x FROM bars GROUP BY 1)), r AS (SELECT *, row_number() OVER (ORDER BY p, symbol) AS k, count(*) OVER () AS n FROM t)
SELECT symbol, round(p, 6) AS p, round(least(1, p * n), 6) AS bonferroni, round(least(1, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM r""")
def j17_multiple_testing(spark, d):
    t = panels.bars(spark, d).groupBy("symbol").agg((2 * (1 - (0.5 + 0.45 * F.tanh(F.abs(F.avg("close") - 50000) / F.stddev_samp("close"))))).alias("p"))
    return r6(sc.corrected_p(t, "p", "symbol"), "symbol", six=["p", "bonferroni", "bh"])


@register("SELECT trial_id, round(CASE WHEN sharpe <= 0.5 THEN 100 WHEN sharpe >= 3 THEN 0 ELSE 100 * (1 - ((sharpe - 0.5) / 2.5) ** 2) END, 6) AS score FROM trials")
def j20_distance_score(spark, d):
    return panels.trials(spark, d).select("trial_id", F.round(sc.distance_score("sharpe", 0.5, 3.0, 2.0), 6).alias("score"))


@register(""", k AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, trial_id) AS k, count(*) OVER () AS n FROM trials) WHERE k <= greatest(10, floor(n * 0.1))) SELECT param, round(quantile_cont(v, 0.25), 6) AS low, round(quantile_cont(v, 0.75), 6) AS high FROM (SELECT unnest(['sharpe', 'drawdown']) AS param, unnest([sharpe, drawdown]) AS v FROM k) GROUP BY 1""")
def j11_range_learning(spark, d):
    return r6(sc.learned_ranges(panels.trials(spark, d), "score", ["sharpe", "drawdown"], 0.1, "trial_id"), "param", six=["low", "high"])


@register("""SELECT trial_id, round((0.4 * a + 0.4 * b + coalesce(0.2 * c, 0)) / (0.8 + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 6) AS smart_score FROM (SELECT trial_id, CASE WHEN sharpe BETWEEN 1 AND 3 THEN 100 ELSE 100 * exp(-greatest(1 - sharpe, sharpe - 3) / 2) END AS a, CASE WHEN drawdown <= 0.2 THEN 100 ELSE 100 * exp(-(drawdown - 0.2) / 0.2) END AS b, CASE WHEN study_id % 3 <> 0 THEN least(score / 20, 100) END AS c FROM trials)""")
def j10_smart_composite(spark, d):
    t = panels.trials(spark, d)
    parts = {"a": (x.inside_score("sharpe", F.lit(1.0), F.lit(3.0)), 0.4), "b": (x.below_score("drawdown", F.lit(0.2)), 0.4), "c": (F.when(F.col("study_id") % 3 != 0, F.least(F.col("score") / 20, F.lit(100.0))), 0.2)}
    return t.select("trial_id", F.round(r.score_column(parts), 6).alias("smart_score"))


@register(f"""{RET}, o AS (SELECT symbol, min(dt) AS d0, max(dt) AS d1 FROM bars GROUP BY 1) SELECT symbol, round(b.close / a.close - 1, 6) AS total, round(b.volume / a.volume - 1, 6) AS earnings, round((b.close / b.volume) / (a.close / a.volume) - 1, 6) AS rerating FROM o JOIN bars a USING (symbol) JOIN bars b USING (symbol) WHERE a.dt = d0 AND b.dt = d1""")
def i30_return_decomposition(spark, d):
    return r6(sc.return_decomposition(panels.bars(spark, d), "close", "volume"), "symbol", six=["total", "earnings", "rerating"])


@register("SELECT symbol, round(0.4 * greatest(0, 1 - a) + 0.25 * b + 0.35 * c, 6) AS mr_score, CASE WHEN 0.4 * greatest(0, 1 - a) + 0.25 * b + 0.35 * c >= 0.6 THEN 'good' ELSE 'poor' END AS grade FROM (SELECT symbol, least(1, stddev_samp(close) / avg(close)) AS a, 0.5 AS b, count(*) / 400.0 AS c FROM bars GROUP BY 1)")
def i28_quality_score(spark, d):
    per = panels.bars(spark, d).groupBy("symbol").agg(F.least(F.lit(1.0), F.stddev_samp("close") / F.avg("close")).alias("a"), (F.count("*") / 400.0).alias("c"))
    total = r.score_column({"a": (F.greatest(F.lit(0.0), 1 - F.col("a")), 0.4), "b": (F.lit(0.5), 0.25), "c": (F.col("c"), 0.35)})
    return per.select("symbol", F.round(total, 6).alias("mr_score"), F.when(total >= 0.6, "good").otherwise("poor").alias("grade"))


#: Correlation of a and b without what c and d share with them, by the correlations r of names.
PARTIAL = """, l AS (SELECT dt, unnest(['discount', 'tax', 'returned', 'quantity']) AS f, unnest([1, 2, 3, 4]) AS i, unnest([discount, tax, returned, quantity]) AS v FROM macro),
r AS (SELECT a.i AS a, b.i AS b, corr(a.v, b.v) AS r FROM l a JOIN l b ON a.dt = b.dt WHERE a.i <> b.i GROUP BY 1, 2),
p AS (SELECT x.a, x.b, y.b AS c, (x.r - y.r * z.r) / sqrt((1 - y.r * y.r) * (1 - z.r * z.r)) AS r FROM r x JOIN r y ON y.a = x.a AND y.b <> x.b JOIN r z ON z.a = x.b AND z.b = y.b),
q AS (SELECT x.a, x.b, (x.r - y.r * z.r) / sqrt((1 - y.r * y.r) * (1 - z.r * z.r)) AS r, x.c FROM p x JOIN p y ON y.a = x.a AND y.c = x.c AND y.b NOT IN (x.a, x.b, x.c) JOIN p z ON z.a = x.b AND z.c = x.c AND z.b = y.b),
n AS (SELECT DISTINCT i, f FROM l)"""


@register(f"{PARTIAL} SELECT x.f AS a, y.f AS b, round(avg(r), 5) + 0.0 AS partial FROM q JOIN n x ON x.i = q.a JOIN n y ON y.i = q.b WHERE q.a < q.b GROUP BY 1, 2")
def i17_partial_correlation(spark, d):
    return r6(sc.partial_correlations(panels.macro(spark, d), ["discount", "tax", "returned", "quantity"]), "a", "b", six=["partial"], places=5)


@register()
def i22_return_clusters(spark, d):
    return sc.clusters(panels.bars(spark, d, "month"), 4)


@register()
def i23_principal_components(spark, d):
    return sc.principal_components(panels.macro(spark, d), ["discount", "tax", "returned", "quantity"], 2)


@register()
def k12_model_scores(spark, d):
    """A logistic model on z features of every pair, trained on the past, scored on the rest."""
    from spreadloom.operators import features as k

    data = k.z_labels(k.z_features(spread_z(spark, d)), horizon=1, entry=1.0, fraction=0.25)
    return sc.trained_scores(data, ["z_abs", "z_mean", "z_std", "z_ar1"], "reverts", "1999-12-31")


@register()
def k20_block_bootstrap(spark, d):
    return sc.block_bootstrap(w.returns(panels.bars(spark, d)).where("ret IS NOT NULL"), "ret", "symbol", 200, 10)


@register("SELECT pair, id // 4 AS r, id % 4 AS c, v FROM (SELECT p_brand AS pair, count(*) AS v, (p_size % 12) AS id FROM part GROUP BY 1, 3)")
def o05_matrix_to_rows(spark, d):
    cells = panels.table(spark, d, "part").groupBy(F.col("p_brand").alias("pair"), (F.col("p_size") % 12).alias("id")).agg(F.count("*").alias("v"))
    m = sc.matrices(cells.select("pair", F.expr("id div 4").cast("int").alias("r"), (F.col("id") % 4).cast("int").alias("c"), "v"), "pair", 3, 4)
    return sc.matrix_cells(m, "pair").where("v IS NOT NULL").select("pair", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")


@register("SELECT pair, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var, sum(v) FILTER (WHERE r = c) AS trace FROM (SELECT p_brand AS pair, (p_size % 12) // 4 AS r, (p_size % 12) % 4 AS c, count(*)::DOUBLE AS v FROM part GROUP BY 1, 2, 3) GROUP BY 1")
def o04_matrix_statistics(spark, d):
    cells = panels.table(spark, d, "part").groupBy(F.col("p_brand").alias("pair"), (F.col("p_size") % 12).alias("id")).agg(F.count("*").cast("double").alias("v"))
    m = sc.matrices(cells.select("pair", F.expr("id div 4").cast("int").alias("r"), (F.col("id") % 4).cast("int").alias("c"), "v"), "pair", 3, 4)
    return sc.matrix_statistics(m, "pair").select("pair", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"), "trace")


@register(f"""{RET}, m AS (SELECT r.symbol, r.ret AS y, quantity AS a, discount AS b FROM r JOIN macro USING (dt) WHERE ret IS NOT NULL),
t AS (SELECT symbol, count(*) AS n, regr_sxx(a, a) AS saa, regr_sxx(b, b) AS sbb, regr_sxy(a, b) AS sab, regr_sxy(a, y) AS say, regr_sxy(b, y) AS sby, regr_sxx(y, y) AS syy FROM m GROUP BY 1 HAVING count(*) > 5),
u AS (SELECT *, saa * sbb - sab * sab AS det FROM t), v AS (SELECT *, (sbb * say - sab * sby) / det AS ba, (saa * sby - sab * say) / det AS bb FROM u),
w AS (SELECT *, ba * say + bb * sby AS explained FROM v), z AS (SELECT *, (syy - explained) / (n - 3) AS s2 FROM w)
SELECT symbol, 'quantity' AS factor, n, round(ba, 6) + 0.0 AS beta, round(ba / sqrt(s2 * sbb / det), 5) + 0.0 AS t, round(explained / syy, 6) AS r2, round((explained - sby * sby / sbb) / syy, 6) + 0.0 AS marginal_r2 FROM z
UNION ALL SELECT symbol, 'discount', n, round(bb, 6) + 0.0, round(bb / sqrt(s2 * saa / det), 5) + 0.0, round(explained / syy, 6), round((explained - say * say / saa) / syy, 6) + 0.0 FROM z""")
def d18_multi_factor_ols(spark, d):
    data = w.returns(panels.bars(spark, d)).where("ret IS NOT NULL").join(panels.macro(spark, d), "dt")
    f = sc.factor_regression(data, "symbol", "ret", ["quantity", "discount"])
    return f.select("symbol", "factor", "n", *[(F.round(c, k) + 0.0).alias(c) for c, k in (("beta", 6), ("t", 5), ("r2", 6), ("marginal_r2", 6))])


@register(f"""{RET}, q AS (SELECT symbol, dt, ret FROM r WHERE ret IS NOT NULL), c AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) AS v, count(*) AS n FROM q a JOIN q b ON a.dt = b.dt AND a.symbol <= b.symbol GROUP BY 1, 2),
k AS (SELECT sum(CASE WHEN a = b THEN 1 ELSE 0 END)::DOUBLE AS p, max(n)::DOUBLE AS n, sum(CASE WHEN a = b THEN v END) AS tr, sum(CASE WHEN a = b THEN v * v ELSE 2 * v * v END) AS tr2 FROM c),
s AS (SELECT *, tr / p AS mu, least(1, ((1 - 2 / p) * tr2 + tr * tr) / ((n + 1 - 2 / p) * (tr2 - tr * tr / p))) AS rho FROM k)
SELECT a, b, round(v, 7) + 0.0 AS sample, round(0.9 * v + CASE WHEN a = b THEN 0.1 * mu ELSE 0 END, 7) + 0.0 AS shrunk, round((1 - rho) * v + CASE WHEN a = b THEN rho * mu ELSE 0 END, 7) + 0.0 AS oas, round(v + CASE WHEN a = b THEN 0.05 * mu ELSE 0 END, 7) + 0.0 AS ridge FROM c, s""", "month")
def i24_covariance_variants(spark, d):
    r = w.returns(panels.bars(spark, d, "month")).where("ret IS NOT NULL").select("symbol", "dt", "ret")
    return r6(sc.covariance_variants(r, 0.1, 0.05), "a", "b", six=["sample", "shrunk", "oas", "ridge"], places=7)


@register()
def i19_nearest_by_warping(spark, d):
    """The nearest partner of every symbol; bounds leave out the pairs that can't be it."""
    return nearest_by_warping(pairs_of(spark, d), 5)
