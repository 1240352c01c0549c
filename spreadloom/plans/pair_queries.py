"""Queries of the pair operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.functions.columns import label_rank, score_label
from spreadloom.operators import pairs as p
from spreadloom.operators.pipelines import ranked as by_cells
from spreadloom.plans.registry import register
from spreadloom.sources import panels

PAIRS = ", px AS (SELECT a.symbol AS sym_x, b.symbol AS sym_y, a.symbol || '/' || b.symbol AS pair_id, a.dt, a.vwap AS x, b.vwap AS y FROM bars a JOIN bars b ON a.dt = b.dt AND a.symbol < b.symbol)"
RETS = PAIRS + ", pr AS (SELECT *, ln(x) - lag(ln(x)) OVER s AS rx, ln(y) - lag(ln(y)) OVER s AS ry FROM px WINDOW s AS (PARTITION BY pair_id ORDER BY dt))"
HEDGE = PAIRS + ", hedge AS (SELECT pair_id, count(*) AS n, regr_slope(ln(x), ln(y)) AS beta, regr_intercept(ln(x), ln(y)) AS intercept FROM px GROUP BY 1), sp AS (SELECT px.pair_id, sym_x, sym_y, dt, ln(x) - intercept - beta * ln(y) AS spread FROM px JOIN hedge USING (pair_id))"
CHG = HEDGE + ", ch AS (SELECT *, lag(spread) OVER s AS b, spread - lag(spread) OVER s AS d FROM sp WINDOW s AS (PARTITION BY pair_id ORDER BY dt))"


def pairs_of(spark, d, grain="month"):
    return p.all_pairs(panels.bars(spark, d, grain), "vwap")


def out(df, *keys, six=()):
    return df.select(*keys, *[(F.round(c, 6) + 0.0).alias(c) for c in six])


@register(", lst AS (SELECT symbol AS sym_x, lead(symbol) OVER (ORDER BY symbol) AS sym_y FROM (SELECT DISTINCT symbol FROM segs)) SELECT sym_x || '/' || sym_y AS pair_id, a.dt, round(a.close, 4) AS x, round(b.close, 4) AS y FROM lst JOIN segs a ON a.symbol = sym_x JOIN segs b ON b.symbol = sym_y AND a.dt = b.dt")
def c01_two_leg_alignment(spark, d):
    from pyspark.sql import Window

    s = panels.segment_bars(spark, d)
    listed = s.select("symbol").distinct().select(F.col("symbol").alias("sym_x"), F.lead("symbol").over(Window.orderBy("symbol")).alias("sym_y")).where("sym_y IS NOT NULL")  # a handful of segments
    return p.aligned(s, listed).select("pair_id", "dt", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@register(f"{PAIRS} SELECT pair_id, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt FROM px GROUP BY 1")
def c02_all_pairs(spark, d):
    return pairs_of(spark, d, "week").groupBy("pair_id").agg(F.count("*").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@register("SELECT l.symbol, l.dt, round(m.tax, 6) AS tax FROM (SELECT symbol, dt, 1 AS k FROM segs) l ASOF LEFT JOIN (SELECT dt, tax, 1 AS k FROM macro WHERE extract('day' FROM dt) <= 7) m ON l.k = m.k AND l.dt >= m.dt")
def c05_as_of(spark, d):
    left = panels.segment_bars(spark, d).select("symbol", "dt")
    right = panels.macro(spark, d).where(F.dayofmonth("dt") <= 7).select("dt", "tax")
    # The factor is one series for all symbols: looked up once for each date of the calendar.
    one = F.lit("factor").alias("series")
    found = p.as_of(left.select(one, "dt").distinct(), right.select(one, "dt", "tax"), "series", "dt", "tax")
    return left.join(found.select("dt", "tax"), "dt").select("symbol", "dt", F.round("tax", 6).alias("tax"))


FOLDS = "(VALUES (1, DATE '1995-01-01', DATE '1997-12-31', DATE '1998-01-15', DATE '1998-06-30'), (2, DATE '1995-01-01', DATE '1998-06-30', DATE '1998-07-15', DATE '1998-12-31'), (3, DATE '1995-01-01', DATE '1998-12-31', DATE '1999-01-15', DATE '1999-06-30'))"


@register(f"SELECT fold, CASE WHEN dt BETWEEN a AND b THEN 'train' ELSE 'test' END AS part, symbol, count(*) AS n, round(avg(close), 4) AS mean FROM segs JOIN {FOLDS} f(fold, a, b, c, e) ON dt BETWEEN a AND b OR dt BETWEEN c AND e GROUP BY 1, 2, 3")
def c06_folds(spark, d):
    folds = spark.sql(f"SELECT * FROM {FOLDS} AS f(fold, train_start, train_end, test_start, test_end)")
    return p.in_folds(panels.segment_bars(spark, d), folds).groupBy("fold", "part", "symbol").agg(F.count("*").alias("n"), F.round(F.avg("close"), 4).alias("mean"))


@register(f"{PAIRS}, pd AS (SELECT DISTINCT pair_id, sym_x, sym_y FROM px), days AS (SELECT pair_id, dt, count(*) AS legs FROM pd JOIN bars ON symbol IN (sym_x, sym_y) GROUP BY 1, 2) SELECT pair_id, count(*) FILTER (WHERE legs = 2) AS n_both, count(*) AS n_any, count(*) FILTER (WHERE legs = 1) AS n_one, round(count(*) FILTER (WHERE legs = 2) / count(*)::DOUBLE, 6) AS overlap FROM days GROUP BY 1")
def c12_day_overlap(spark, d):
    series = panels.bars(spark, d)
    listed = p.all_pairs(series, "vwap").select("pair_id", "sym_x", "sym_y").distinct()
    return out(p.day_overlap(series, listed), "pair_id", "n_both", "n_any", "n_one", six=["overlap"])


@register(f"{RETS} SELECT pair_id, count(rx) AS n, round(corr(rx, ry), 6) AS corr, round(greatest(stddev_samp(rx), stddev_samp(ry)) / least(stddev_samp(rx), stddev_samp(ry)), 6) AS vol_ratio, coalesce(count(rx) >= 24 AND abs(corr(rx, ry)) BETWEEN 0.1 AND 0.995 AND greatest(stddev_samp(rx), stddev_samp(ry)) / least(stddev_samp(rx), stddev_samp(ry)) <= 5, false) AS is_candidate FROM pr GROUP BY 1", "month")
def d13_pair_correlation(spark, d):
    return out(p.pair_correlation(pairs_of(spark, d), 0.1, least=24), "pair_id", "n", "is_candidate", six=["corr", "vol_ratio"])


@register(f"{PAIRS}, k AS (SELECT pair_id, rank() OVER (PARTITION BY pair_id ORDER BY x) + (count(*) OVER (PARTITION BY pair_id, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY pair_id ORDER BY y) + (count(*) OVER (PARTITION BY pair_id, y) - 1) / 2.0 AS b FROM px) SELECT pair_id, count(*) AS n, round(corr(a, b), 6) AS spearman FROM k GROUP BY 1", "month")
def d14_rank_correlation(spark, d):
    return out(p.rank_correlation(pairs_of(spark, d)), "pair_id", "n", six=["spearman"])


@register(f"{PAIRS}, f AS (SELECT pair_id, x / first_value(x) OVER s - y / first_value(y) OVER s AS d FROM px WINDOW s AS (PARTITION BY pair_id ORDER BY dt)) SELECT pair_id, round(avg(d * d), 6) AS ssd, round(greatest(0, 1 - avg(d * d)), 6) AS score FROM f GROUP BY 1", "month")
def d15_price_distance(spark, d):
    return out(p.price_distance(pairs_of(spark, d)), "pair_id", six=["ssd", "score"])


@register(f"{HEDGE} SELECT pair_id, n, round(beta, 6) AS beta, round(intercept, 6) AS intercept, round(sd, 6) AS resid_sd FROM hedge JOIN (SELECT pair_id, stddev_samp(spread) AS sd FROM sp GROUP BY 1) USING (pair_id)", "month")
def d16_static_hedge(spark, d):
    return out(p.static_hedge(pairs_of(spark, d)), "pair_id", "n", six=["beta", "intercept", "resid_sd"])


@register(f"{PAIRS}, m AS (SELECT pair_id, var_samp(ln(x)) AS vx, var_samp(ln(y)) AS vy, covar_samp(ln(x), ln(y)) AS c FROM px GROUP BY 1) SELECT pair_id, round((vx - vy + sqrt((vx - vy) ** 2 + 4 * c * c)) / (2 * c), 4) AS tls_beta FROM m", "month")
def d17_tls_hedge(spark, d):
    return p.static_hedge(pairs_of(spark, d)).select("pair_id", F.round("tls_beta", 4).alias("tls_beta"))


@register(f"{CHG}, k AS (SELECT pair_id, count(d) AS n, regr_slope(d, b) AS kappa FROM ch GROUP BY 1) SELECT pair_id, n, round(kappa, 6) AS kappa, round(CASE WHEN n + 1 < 20 THEN NULL WHEN kappa >= 0 THEN 'inf'::DOUBLE ELSE -ln(2) / kappa END, 6) AS half_life FROM k", "month")
def i01_half_life(spark, d):
    x = pairs_of(spark, d)
    return out(p.half_life(p.spread(x, p.static_hedge(x))), "pair_id", "n", six=["kappa", "half_life"])


@register(f"{CHG}, k AS (SELECT pair_id, count(*) AS n, regr_slope(d, b) AS g, regr_syy(d, b) AS syy, regr_sxx(d, b) AS sxx, regr_sxy(d, b) AS sxy FROM ch WHERE d IS NOT NULL GROUP BY 1) SELECT pair_id, n, round(g, 6) AS gamma, round(g / sqrt((syy - g * sxy) / (n - 2) / sxx), 6) AS adf_t FROM k", "month")
def i02_dickey_fuller(spark, d):
    x = pairs_of(spark, d)
    return out(p.dickey_fuller(p.spread(x, p.static_hedge(x))), "pair_id", "n", six=["gamma", "adf_t"])


@register(f"""{CHG}, e AS (SELECT pair_id, dt, d - avg(d) OVER (PARTITION BY pair_id) AS e, spread - lag(spread, 5) OVER (PARTITION BY pair_id ORDER BY dt) - 5 * avg(d) OVER (PARTITION BY pair_id) AS ek FROM ch),
l AS (SELECT *, lag(e, 1) OVER s AS e1, lag(e, 2) OVER s AS e2, lag(e, 3) OVER s AS e3, lag(e, 4) OVER s AS e4 FROM e WINDOW s AS (PARTITION BY pair_id ORDER BY dt)),
a AS (SELECT pair_id, count(e) AS n, sum(e * e) AS s1, sum(ek * ek) AS sk, sum(e * e * e1 * e1) AS c1, sum(e * e * e2 * e2) AS c2, sum(e * e * e3 * e3) AS c3, sum(e * e * e4 * e4) AS c4 FROM l GROUP BY 1)
SELECT pair_id, n, round(sk / 5 / s1, 6) AS vr, round((sk / 5 / s1 - 1) / sqrt((1.6 ** 2 * c1 + 1.2 ** 2 * c2 + 0.8 ** 2 * c3 + 0.4 ** 2 * c4) / (s1 * s1)), 6) AS vr_z FROM a""", "month")
def i07_variance_ratio(spark, d):
    x = pairs_of(spark, d)
    return out(p.variance_ratio(p.spread(x, p.static_hedge(x))), "pair_id", "n", six=["vr", "vr_z"])


@register(f"""{PAIRS}, r AS (SELECT pair_id, ln(x) AS lx, ln(y) AS ly, row_number() OVER (PARTITION BY pair_id ORDER BY dt) - 1 AS rn, count(*) OVER (PARTITION BY pair_id) AS n FROM px),
b AS (SELECT pair_id, k, regr_slope(lx, ly) AS beta FROM r, range(0, 8) g(k) WHERE rn >= k * floor((n - 30) / 7) AND rn < k * floor((n - 30) / 7) + 30 GROUP BY 1, 2) SELECT pair_id, round(greatest(0, 1 - stddev_pop(beta) / abs(avg(beta))), 4) AS stability FROM b GROUP BY 1""", "month")
def i08_hedge_stability(spark, d):
    return p.hedge_stability(pairs_of(spark, d), 8, 30).select("pair_id", F.round("stability", 4).alias("stability"))


@register(f"""{RETS}, a AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY dt DESC) AS age FROM pr), s AS (SELECT pair_id, corr(rx, ry) FILTER (WHERE age <= 12) AS c1, corr(rx, ry) FILTER (WHERE age <= 24) AS c2, corr(rx, ry) AS c FROM a GROUP BY 1)
SELECT pair_id, round(c1, 6) AS corr_12, round(c2, 6) AS corr_24, round(c, 6) AS corr_all, CASE WHEN c1 > c + 0.1 THEN 'rising' WHEN c1 < c - 0.1 THEN 'falling' ELSE 'stable' END AS trend FROM s""", "month")
def i13_correlation_snapshot(spark, d):
    return out(p.correlation_snapshot(pairs_of(spark, d), (12, 24)), "pair_id", "trend", six=["corr_12", "corr_24", "corr_all"])


@register(f"""{PAIRS}, q AS (SELECT pair_id, quantile_cont(x, 0.9) AS xu, quantile_cont(y, 0.9) AS yu, quantile_cont(x, 0.1) AS xl, quantile_cont(y, 0.1) AS yl FROM px GROUP BY 1)
SELECT pair_id, round(count(*) FILTER (WHERE x > xu AND y > yu) / nullif(count(*) FILTER (WHERE x > xu), 0)::DOUBLE, 6) AS upper, round(count(*) FILTER (WHERE x < xl AND y < yl) / nullif(count(*) FILTER (WHERE x < xl), 0)::DOUBLE, 6) AS lower FROM px JOIN q USING (pair_id) GROUP BY 1""", "month")
def i14_tail_dependence(spark, d):
    return out(p.tail_dependence(pairs_of(spark, d)), "pair_id", six=["upper", "lower"])


@register(f"{RETS}, c AS (SELECT sym_x, sym_y, corr(rx, ry) AS corr FROM pr GROUP BY 1, 2) SELECT symbol, count(*) AS degree FROM (SELECT sym_x AS symbol FROM c WHERE abs(corr) >= 0.1 UNION ALL SELECT sym_y FROM c WHERE abs(corr) >= 0.1) GROUP BY 1", "month")
def i21_network_degree(spark, d):
    return p.degree(p.pair_correlation(pairs_of(spark, d)), 0.1)


@register(f"{PAIRS} SELECT symbol AS sym_x, symbol AS sym_y, round(var_samp(vwap), 2) AS cov FROM bars GROUP BY 1 UNION ALL SELECT sym_x, sym_y, round(covar_samp(x, y) * 0.9, 2) FROM px GROUP BY 1, 2", "month")
def i24_shrunk_covariance(spark, d):
    series = panels.bars(spark, d, "month")
    return p.shrunk_covariance(p.all_pairs(series, "vwap"), series, "vwap").select("sym_x", "sym_y", F.round("cov", 2).alias("cov"))


@register(f"{RETS}, c AS (SELECT pair_id, corr(rx, ry) AS corr FROM pr GROUP BY 1), n AS (SELECT count(DISTINCT symbol) AS n FROM bars) SELECT round(max(n) * max(n) / (max(n) + 2 * sum(corr * corr)), 6) AS effective_bets FROM c, n", "month")
def i25_effective_bets(spark, d):
    series = panels.bars(spark, d, "month")
    n = series.agg(F.countDistinct("symbol").alias("n_symbols"))
    return out(p.effective_bets(p.pair_correlation(p.all_pairs(series, "vwap")).join(n, how="cross"), 0), six=["effective_bets"])


METRICS = CHG + """, q AS (SELECT *, spread - max(spread) OVER (PARTITION BY pair_id ORDER BY dt) AS dd FROM ch),
m AS (SELECT pair_id, sym_x, sym_y, count(*) AS n_obs, avg(d) / nullif(stddev_samp(d), 0) * sqrt(52) AS spread_sharpe, avg(d) / nullif(sqrt(avg(least(d, 0) ** 2) FILTER (WHERE d IS NOT NULL)), 0) * sqrt(52) AS spread_sortino, stddev_samp(d) AS spread_vol, min(dd) AS spread_max_dd,
  avg((d > 0)::INT::DOUBLE) AS spread_pos_ratio, avg((d < 0)::INT::DOUBLE) AS spread_neg_ratio, regr_slope(d, b) AS kappa FROM q GROUP BY 1, 2, 3),
c AS (SELECT pair_id, corr(rx, ry) AS corr FROM (SELECT pair_id, ln(x) - lag(ln(x)) OVER s AS rx, ln(y) - lag(ln(y)) OVER s AS ry FROM px WINDOW s AS (PARTITION BY pair_id ORDER BY dt)) GROUP BY 1),
pm AS (SELECT m.*, corr, beta, intercept, CASE WHEN n_obs < 20 THEN NULL WHEN kappa >= 0 THEN 'inf'::DOUBLE ELSE -ln(2) / kappa END AS half_life FROM m JOIN c USING (pair_id) JOIN hedge USING (pair_id))"""
SIX = ["corr", "beta", "intercept", "half_life", "spread_sharpe", "spread_vol", "spread_max_dd", "spread_pos_ratio", "spread_neg_ratio"]


@register(f"{METRICS} SELECT pair_id, sym_x, sym_y, n_obs, {', '.join(f'round({c}, 6) AS {c}' for c in SIX)} FROM pm")
def j01_pair_metrics(spark, d):
    return out(p.pair_metrics(pairs_of(spark, d, "week")), "pair_id", "sym_x", "sym_y", "n_obs", six=SIX)


@register(f"""{METRICS}, s AS (SELECT *, greatest(-1, least(2, coalesce(spread_sharpe, 0))) AS rr, coalesce(abs(corr), 0) + CASE WHEN half_life BETWEEN 2 AND 120 THEN 0.5 ELSE 0 END AS sq, CASE WHEN n_obs < 50 THEN 0.5 ELSE 0 END AS pen FROM pm),
t AS (SELECT *, rr + sq - pen AS score FROM s), l AS (SELECT *, CASE WHEN score >= 2.0 THEN 'A+' WHEN score >= 1.5 THEN 'A' WHEN score >= 1.2 THEN 'A-' WHEN score >= 0.9 THEN 'B+' WHEN score >= 0.6 THEN 'B' WHEN score >= 0.3 THEN 'B-' WHEN score >= 0 THEN 'C' ELSE 'D' END AS pair_label FROM t)
SELECT pair_id, round(score, 6) AS pair_score, pair_label, (list_position(['D', 'C', 'B-', 'B', 'B+', 'A-', 'A', 'A+'], pair_label) - 1)::INT AS label_rank, coalesce(n_obs >= 24 AND half_life BETWEEN 0.1 AND 120 AND corr < 0.999 AND spread_vol > 1e-8 AND spread_sharpe >= -10, false) AS is_viable, rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, pair_id) AS rank FROM l)""")
def j02_pair_ranking(spark, d):
    """The flagship: metrics of all pairs, score, label, viability and rank; a caller takes as many as it wants."""
    scored = p.pair_score(p.pair_metrics(pairs_of(spark, d, "week")))
    ranked = by_cells(scored, F.round("pair_score", 9), "pair_id")
    label = score_label("pair_score")
    return ranked.select("pair_id", F.round("pair_score", 6).alias("pair_score"), label.alias("pair_label"), label_rank(label).cast("int").alias("label_rank"), p.is_viable(24, 0.1, 120, min_sharpe=-10.0).alias("is_viable"), "rank")


@register(f"""{PAIRS}, c AS (SELECT pair_id, dt, CASE WHEN count(*) OVER w = 12 THEN corr(x, y) OVER w END AS s FROM px WINDOW w AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT pair_id, dt, round(s, 6) AS corr_s, CASE WHEN count(s) OVER w = 36 THEN round((s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0), 5) END AS corr_z FROM c WINDOW w AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)""", "month")
def i13_rolling_health(spark, d):
    h = p.rolling_health(pairs_of(spark, d), 12, 36)
    return h.select("pair_id", "dt", (F.round("corr_s", 6) + 0.0).alias("corr_s"), (F.round("corr_z", 5) + 0.0).alias("corr_z"))
