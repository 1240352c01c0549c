"""Queries of regressions, distances and components from moments, and of permutation importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.functions import columns as x
from spreadloom.operators import features as k
from spreadloom.operators import importance as imp
from spreadloom.operators import moments as mo
from spreadloom.operators import scoring as sc
from spreadloom.plans.job_queries import SPZ, spread_z
from spreadloom.plans.registry import register
from spreadloom.plans.table_queries import r6
from spreadloom.sources import panels

CHANGES = ", ch AS (SELECT symbol, dt, ln(high) - lag(ln(high)) OVER s AS h, ln(low) - lag(ln(low)) OVER s AS l, ln(vwap) - lag(ln(vwap)) OVER s AS v FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY dt)), m AS (SELECT * FROM ch WHERE h IS NOT NULL)"


def changes(spark, d):
    step = lambda c: F.ln(c) - F.lag(F.ln(c)).over(x.ordered())
    return panels.bars(spark, d).select("symbol", "dt", step("high").alias("h"), step("low").alias("l"), step("vwap").alias("v"))


@register(f"""{CHANGES}, c AS (SELECT symbol, avg(h) AS mh, avg(v) AS mv, var_samp(h) AS a, covar_samp(h, v) AS b, var_samp(v) AS c FROM m GROUP BY 1)
SELECT symbol, dt, round(sqrt((c * (h - mh) ** 2 - 2 * b * (h - mh) * (v - mv) + a * (v - mv) ** 2) / (a * c - b * b)), 5) + 0.0 AS distance FROM m JOIN c USING (symbol)""")
def i26_mahalanobis_static(spark, d):
    return r6(mo.distances(changes(spark, d), "symbol", ["h", "v"]), "symbol", "dt", six=["distance"], places=5)


@register(f"""{CHANGES}, c AS (SELECT *, avg(h) OVER w AS mh, avg(v) OVER w AS mv, var_samp(h) OVER w AS a, covar_samp(h, v) OVER w AS b, var_samp(v) OVER w AS c, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))
SELECT symbol, dt, CASE WHEN n = 52 THEN round(sqrt((c * (h - mh) ** 2 - 2 * b * (h - mh) * (v - mv) + a * (v - mv) ** 2) / (a * c - b * b)), 5) + 0.0 END AS distance FROM c""")
def i26_mahalanobis_rolling(spark, d):
    return r6(mo.rolling_distances(changes(spark, d), "symbol", ["h", "v"], 52), "symbol", "dt", six=["distance"], places=5)


@register(f"""{CHANGES}, c AS (SELECT symbol, dt, count(*) OVER w AS n, var_pop(h) OVER w AS a, var_pop(l) OVER w AS b, var_pop(v) OVER w AS c, covar_pop(h, l) OVER w AS d, covar_pop(h, v) OVER w AS e, covar_pop(l, v) OVER w AS f FROM m
  WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM c WHERE n = 52),
r AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3)))) / 3 AS phi FROM q),
v AS (SELECT symbol, dt, q, q + 2 * p * cos(phi) AS top, q + 2 * p * cos(phi + 2 * pi() / 3) AS least FROM r)
SELECT symbol, dt, round(top / (3 * q), 6) + 0.0 AS first, round((3 * q - top - least) / (3 * q), 6) + 0.0 AS second, round((3 * q - least) / (3 * q), 6) + 0.0 AS ratio, round(sqrt(greatest(0, least) / 3), 6) + 0.0 AS residual_sd FROM v
UNION ALL SELECT symbol, dt, NULL, NULL, NULL, NULL FROM c WHERE n < 52""")
def i23_rolling_components(spark, d):
    """Two components of the changes of high, low and mean price of every symbol, over the last 52 weeks."""
    c = mo.rolling_components(changes(spark, d), "symbol", ["h", "l", "v"], 52, 2)
    return r6(c.withColumns({"first": F.get("explained", F.lit(0)), "second": F.get("explained", F.lit(1))}), "symbol", "dt", six=["first", "second", "ratio", "residual_sd"])


TRAIN_END = "1999-12-31"


def reversion(spark, d):
    """z features of every pair, and whether a far z falls to a quarter of itself by the next row, as about two thirds do."""
    return k.z_labels(k.z_features(spread_z(spark, d)), horizon=1, entry=1.0, fraction=0.25)


#: Rows of the spread's z up to the end of training: the next change of z, from z and its last change.
NEXT = f""", zn AS (SELECT pair_id, dt, z, z - lag(z) OVER s AS step, lead(z) OVER s - z AS next FROM zs WINDOW s AS (PARTITION BY pair_id ORDER BY dt)),
tr AS (SELECT * FROM zn WHERE dt <= DATE '{TRAIN_END}' AND z IS NOT NULL AND step IS NOT NULL AND next IS NOT NULL),
mm AS (SELECT pair_id, count(*) AS n, avg(z) AS mz, avg(step) AS ms, avg(next) AS my, stddev_pop(z) AS sz, stddev_pop(step) AS ss, covar_pop(z, step) / (stddev_pop(z) * stddev_pop(step)) AS r,
  covar_pop(z, next) / stddev_pop(z) AS bz, covar_pop(step, next) / stddev_pop(step) AS bs, var_pop(next) AS vy FROM tr GROUP BY 1)"""


def next_steps(spark, d):
    o = x.ordered("pair_id")
    return spread_z(spark, d).select("pair_id", "dt", "z", (F.col("z") - F.lag("z").over(o)).alias("step"), (F.lead("z").over(o) - F.col("z")).alias("next"))


@register(f"""{SPZ}{NEXT}, w AS (SELECT *, ((1 + p) * bz - r * bs) / ((1 + p) ** 2 - r * r) AS wz, ((1 + p) * bs - r * bz) / ((1 + p) ** 2 - r * r) AS ws FROM mm, (VALUES (0.01), (0.1), (1.0)) t(p))
SELECT pair_id, p::DOUBLE AS penalty, f AS feature, n, round(CASE f WHEN 'z' THEN wz / sz ELSE ws / ss END, 5) + 0.0 AS coefficient, round(CASE f WHEN 'z' THEN wz ELSE ws END, 5) + 0.0 AS weight,
  round(my - wz / sz * mz - ws / ss * ms, 5) + 0.0 AS intercept, round((2 * (bz * wz + bs * ws) - wz * wz - ws * ws - 2 * r * wz * ws) / vy, 5) + 0.0 AS r2 FROM w, (VALUES ('z'), ('step')) u(f)""", "month")
def k12_ridge(spark, d):
    """Ridge of the next change of z for every pair, by three penalties."""
    rows = next_steps(spark, d).where(F.col("dt") <= F.lit(TRAIN_END).cast("date"))
    return r6(mo.elastic_net(rows, "pair_id", "next", ["z", "step"], [0.01, 0.1, 1.0], 0.0, TRAIN_END), "pair_id", "penalty", "feature", "n", six=["coefficient", "weight", "intercept", "r2"], places=5)


@register(f"""{SPZ}{NEXT}, w AS (SELECT pair_id, 0 AS k, 0.0::DOUBLE AS wz, 0.0::DOUBLE AS ws FROM mm UNION ALL
  SELECT pair_id, k + 1, az, sign(bs - r * az) * greatest(abs(bs - r * az) - 0.03, 0) / 1.03
  FROM (SELECT w.pair_id, k, bz, bs, r, sign(bz - r * ws) * greatest(abs(bz - r * ws) - 0.03, 0) / 1.03 AS az FROM w JOIN mm ON w.pair_id = mm.pair_id WHERE k < 150)),
e AS (SELECT * FROM w JOIN mm USING (pair_id) WHERE k = 150)
SELECT pair_id, f AS feature, n, round(CASE f WHEN 'z' THEN wz / sz ELSE ws / ss END, 5) + 0.0 AS coefficient, round(CASE f WHEN 'z' THEN wz ELSE ws END, 5) + 0.0 AS weight, round(my - wz / sz * mz - ws / ss * ms, 5) + 0.0 AS intercept,
  round((2 * (bz * wz + bs * ws) - wz * wz - ws * ws - 2 * r * wz * ws) / vy, 5) + 0.0 AS r2 FROM e, (VALUES ('z'), ('step')) u(f)""", "month", recursive=True)
def k12_elastic_net(spark, d):
    """Elastic net of the next change of z for every pair, half lasso and half ridge."""
    rows = next_steps(spark, d).where(F.col("dt") <= F.lit(TRAIN_END).cast("date"))
    return r6(mo.elastic_net(rows, "pair_id", "next", ["z", "step"], [0.06], 0.5, TRAIN_END).drop("penalty"), "pair_id", "feature", "n", six=["coefficient", "weight", "intercept", "r2"], places=5)


@register(f"""{SPZ}{NEXT}, w AS (SELECT pair_id, mz, ms, my, sz, ss, (1.1 * bz - r * bs) / (1.21 - r * r) AS wz, (1.1 * bs - r * bz) / (1.21 - r * r) AS ws FROM mm)
SELECT pair_id, dt, round(my + wz / sz * (z - mz) + ws / ss * (step - ms), 5) + 0.0 AS score FROM zn LEFT JOIN w USING (pair_id) WHERE dt > DATE '{TRAIN_END}'""", "month")
def k12_ridge_scores(spark, d):
    """Later rows scored by their pair's ridge."""
    rows, end = next_steps(spark, d), F.lit(TRAIN_END).cast("date")
    model = mo.elastic_net(rows.where(F.col("dt") <= end), "pair_id", "next", ["z", "step"], [0.1], 0.0, TRAIN_END)
    return r6(mo.linear_scores(rows.where(F.col("dt") > end), model, "pair_id", ["z", "step"]), "pair_id", "dt", six=["score"], places=5)


@register()
def k12_tree_scores(spark, d):
    """Random forest and boosted trees on z features of every pair, trained on the past, scored on the rest."""
    return sc.tree_scores(reversion(spark, d), ["z_abs", "z_mean", "z_std", "z_ar1"], "reverts", TRAIN_END)


IMPORTANCE = ["z_abs", "z_std", "z_mom"]


def stated_score(df):
    """A stated model: reversion is likelier far out and in calm spreads."""
    return df.withColumn("p", 1 / (1 + F.exp(-(1.2 * F.col("z_abs") - 1.5 * F.col("z_std") - 0.3 * F.col("z_mom") - 0.4))))


P = "1 / (1 + exp(-(1.2 * {a} - 1.5 * {s} - 0.3 * {m} - 0.4)))"


@register(f"""{SPZ}, b AS (SELECT *, lag(z, 5) OVER s AS b5 FROM zs WINDOW s AS (PARTITION BY pair_id ORDER BY dt)),
f AS (SELECT pair_id, dt, z, abs(z) AS z_abs, CASE WHEN count(z) OVER v = 20 THEN stddev_samp(z) OVER v END AS z_std, z - b5 AS z_mom,
  count(z) OVER w AS n, min(z) OVER w AS lo, max(z) OVER w AS hi FROM b
  WINDOW v AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
y AS MATERIALIZED (SELECT pair_id, dt, z_abs AS a, z_std AS s, z_mom AS m, (CASE WHEN z > 0 THEN lo ELSE -hi END <= 0.25 * abs(z))::INT::DOUBLE AS y FROM f WHERE abs(z) >= 1.0 AND n = 1 AND z_std IS NOT NULL AND z_mom IS NOT NULL),
t AS (SELECT y.*, rep, row_number() OVER (PARTITION BY rep ORDER BY md5((42 + rep) || '/to/' || pair_id || '/' || dt), pair_id, dt) AS i, row_number() OVER (PARTITION BY rep ORDER BY md5((42 + rep) || '/from/' || pair_id || '/' || dt), pair_id, dt) AS j
  FROM y, (SELECT unnest(range(5)) AS rep)),
o AS (SELECT t.y, t.a, t.s, t.m, t.rep, g.a AS oa, g.s AS os, g.m AS om FROM t JOIN t g ON g.rep = t.rep AND g.j = t.i),
p AS (SELECT rep, y, 'z_abs' AS feature, {P.format(a='oa', s='s', m='m')} AS p FROM o UNION ALL SELECT rep, y, 'z_std', {P.format(a='a', s='os', m='m')} FROM o UNION ALL SELECT rep, y, 'z_mom', {P.format(a='a', s='s', m='om')} FROM o),
w AS (SELECT avg((y = (p >= 0.5)::INT)::INT) AS accuracy, avg((p - y) ** 2) AS brier FROM (SELECT y, {P.format(a='a', s='s', m='m')} AS p FROM y)),
r AS (SELECT feature, rep, avg((y = (p >= 0.5)::INT)::INT) AS a, avg((p - y) ** 2) AS b FROM p GROUP BY 1, 2)
SELECT feature, round(max(accuracy), 6) + 0.0 AS accuracy, round(max(brier), 6) + 0.0 AS brier, round(avg(accuracy - a), 6) + 0.0 AS accuracy_drop, round(stddev_samp(accuracy - a), 6) + 0.0 AS accuracy_sd,
  round(avg(b - brier), 6) + 0.0 AS brier_rise, round(stddev_samp(b - brier), 6) + 0.0 AS brier_sd FROM r, w GROUP BY 1""", "month")
def k18_permutation_importance(spark, d):
    """Drops of a stated score of reversion when its features are permuted, five times."""
    found = imp.permutation_importance(reversion(spark, d), ["pair_id", "dt"], IMPORTANCE, "reverts", stated_score, 5)
    return r6(found, "feature", six=["accuracy", "brier", "accuracy_drop", "accuracy_sd", "brier_rise", "brier_sd"])
