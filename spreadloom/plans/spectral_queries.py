"""Queries of spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.functions import columns as x
from spreadloom.operators import dislocation
from spreadloom.operators import spectral as sp
from spreadloom.plans.pair_queries import RETS, pairs_of
from spreadloom.plans.registry import register
from spreadloom.plans.table_queries import r6
from spreadloom.sources import panels

BANDS = {"slow": (0.0, 0.125), "middle": (0.125, 0.3), "fast": (0.3, 0.5)}
BAND_SQL = "(VALUES " + ", ".join(f"('{name}', {low}, {high})" for name, (low, high) in BANDS.items()) + ") b(band, low, high)"


def pair_returns(spark, d):
    o = x.ordered("pair_id")
    step = lambda c: F.ln(c) - F.lag(F.ln(c)).over(o)
    return pairs_of(spark, d).select("pair_id", "dt", step("x").alias("x"), step("y").alias("y"))


#: Transforms a + ib of x and c + id of y by pair, segment of 24 rows and frequency.
TURNED = f"""{RETS}, n AS (SELECT pair_id, rx AS x, ry AS y, row_number() OVER (PARTITION BY pair_id ORDER BY dt) - 1 AS k FROM pr WHERE rx IS NOT NULL AND ry IS NOT NULL),
e AS (SELECT *, unnest(range(greatest(0, floor((k - 24) / 12.0)::BIGINT + 1), k // 12 + 1)) AS seg FROM n),
s AS (SELECT pair_id, seg, k - 12 * seg AS j, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, count(*) OVER w AS m, 0.5 - 0.5 * cos((k - 12 * seg) * 2 * pi() / 24) AS h FROM e WINDOW w AS (PARTITION BY pair_id, seg)),
t AS (SELECT pair_id, seg, f, sum(x * h * cos(f * j * 2 * pi() / 24)) AS a, -sum(x * h * sin(f * j * 2 * pi() / 24)) AS b,
        sum(y * h * cos(f * j * 2 * pi() / 24)) AS c, -sum(y * h * sin(f * j * 2 * pi() / 24)) AS d FROM s, (SELECT unnest(range(13)) AS f) WHERE m = 24 GROUP BY 1, 2, 3),
c AS (SELECT pair_id, f, count(*) AS segments, avg(a * a + b * b) AS pxx, avg(c * c + d * d) AS pyy, avg(a * c + b * d) AS re, avg(a * d - b * c) AS im FROM t GROUP BY 1, 2)"""


@register(f"""{TURNED}, w AS (SELECT *, CASE WHEN segments > 1 AND pxx * pyy > 0 THEN (re * re + im * im) / (pxx * pyy) END AS coh, sum(pxx) OVER p AS ox, sum(pyy) OVER p AS oy FROM c WINDOW p AS (PARTITION BY pair_id))
SELECT pair_id, band, max(segments) AS segments, round(avg(coh), 6) + 0.0 AS coherence, round(atan2(sum(im), sum(re)), 6) + 0.0 AS phase, round(atan2(sum(im), sum(re)) * 24 / (2 * pi() * avg(f)), 5) + 0.0 AS lag,
  round(sum(pxx) / max(ox), 6) + 0.0 AS power_x, round(sum(pyy) / max(oy), 6) + 0.0 AS power_y FROM w JOIN {BAND_SQL} ON f / 24.0 BETWEEN low AND high GROUP BY 1, 2""", "month")
def i18_coherence(spark, d):
    """Coherence, phase and band powers of the returns of every pair."""
    c = sp.coherence(pair_returns(spark, d), 24, BANDS).withColumn("lag", F.round("lag", 5) + 0.0)
    return r6(c.withColumnRenamed("lag", "_lag"), "pair_id", "band", "segments", "_lag", six=["coherence", "phase", "power_x", "power_y"]).withColumnRenamed("_lag", "lag")


@register(f"""{TURNED} SELECT pair_id, f, segments, round(1e6 * pxx, 5) + 0.0 AS pxx, round(1e6 * pyy, 5) + 0.0 AS pyy, round(1e6 * re, 5) + 0.0 AS re, round(1e6 * im, 5) + 0.0 AS im FROM c""", "month")
def i18_cross_spectrum(spark, d):
    c = sp.cross_spectrum(pair_returns(spark, d), 24)
    return c.select("pair_id", F.col("f").cast("long").alias("f"), "segments", *[(F.round(1e6 * F.col(n), 5) + 0.0).alias(n) for n in ("pxx", "pyy", "re", "im")])


@register(""", n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n, sum(close * close) OVER (PARTITION BY symbol) AS total FROM bars),
b AS (SELECT symbol, level, k // (1 << level) AS block, count(*) AS m, sum(close * CASE WHEN (k // (1 << (level - 1))) % 2 = 0 THEN 1 ELSE -1 END) / sqrt(1 << level) AS detail, max(total) AS total
  FROM n, (SELECT unnest(range(1, 7)) AS level) WHERE n >= 4 * (1 << (level - 1)) GROUP BY 1, 2, 3)
SELECT symbol, any_value(level)::INT AS level, any_value(1 << level)::INT AS shortest, any_value(2 << level)::INT AS longest, round(sum(detail * detail), 3) + 0.0 AS energy, round(sum(detail * detail) / max(total), 6) + 0.0 AS share,
  round(avg(abs(detail)), 5) + 0.0 AS amplitude, sum(detail * detail) / max(total) > 0.25 AS cycle FROM b WHERE m = 1 << level GROUP BY symbol, b.level""")
def i18_haar_energy(spark, d):
    h = sp.haar_energy(panels.bars(spark, d), "close", 6)
    return h.select("symbol", "level", "shortest", "longest", *[(F.round(c, k) + 0.0).alias(c) for c, k in (("energy", 3), ("share", 6), ("amplitude", 5))], "cycle")


@register(f""", n AS (SELECT symbol, dt, close, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS k FROM bars),
t AS (SELECT symbol, dt, k, f, sum(close * cos(f * k * 2 * pi() / 26)) OVER w AS re, sum(close * sin(f * k * 2 * pi() / 26)) OVER w AS im FROM n, (SELECT unnest(range(1, 14)) AS f)
  WINDOW w AS (PARTITION BY symbol, f ORDER BY k ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
p AS (SELECT symbol, dt, f, re * re + im * im AS p, sum(re * re + im * im) OVER (PARTITION BY symbol, dt) AS total FROM t WHERE k >= 25)
SELECT symbol, dt, band, round(sum(p) / max(total), 6) + 0.0 AS power FROM p JOIN {BAND_SQL} ON f / 26.0 BETWEEN low AND high GROUP BY 1, 2, 3""")
def i18_rolling_band_power(spark, d):
    return r6(sp.rolling_band_power(panels.bars(spark, d), "close", 26, BANDS), "symbol", "dt", "band", six=["power"])


@register(f"""{RETS}, r AS (SELECT pair_id, dt, rx, ry, row_number() OVER (PARTITION BY pair_id ORDER BY dt DESC) - 1 AS age FROM pr WHERE rx IS NOT NULL AND ry IS NOT NULL),
c AS (SELECT *, CASE WHEN count(*) OVER a = 12 THEN corr(rx, ry) OVER a END AS cs, CASE WHEN count(*) OVER b = 36 THEN corr(rx, ry) OVER b END AS cl, corr(rx, ry) OVER b AS cm FROM r
  WINDOW a AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)),
u AS (SELECT *, (cs - avg(cs) OVER w) / stddev_samp(cs) OVER w AS u FROM c WINDOW w AS (PARTITION BY pair_id)),
p AS (SELECT *, sum(u) OVER (PARTITION BY pair_id ORDER BY dt) AS path FROM u),
o AS (SELECT pair_id, count(*) AS n, max(CASE WHEN age = 0 THEN cs END) AS s, max(CASE WHEN age = 12 THEN cs END) AS b, avg(cl) AS l, stddev_samp(cs) AS sd, count(cs) AS m, max(path) - min(path) AS cu, max(CASE WHEN age = 0 THEN u END) AS away, max(CASE WHEN age = 0 THEN cm END) AS mid,
  sum(h) AS h, sum(h * rx) AS hx, sum(h * ry) AS hy, sum(h * rx * ry) AS hxy, sum(h * rx * rx) AS hxx, sum(h * ry * ry) AS hyy FROM (SELECT *, pow(0.5, age / 12.0) AS h FROM p) GROUP BY 1),
k AS (SELECT * REPLACE (CASE WHEN n >= 60 THEN s END AS s, CASE WHEN n >= 60 THEN b END AS b, CASE WHEN n >= 60 THEN mid END AS mid, CASE WHEN n >= 60 THEN l END AS l, CASE WHEN n >= 60 THEN cu END AS cu, CASE WHEN n >= 60 THEN away END AS away, CASE WHEN n >= 60 THEN hxy END AS hxy) FROM o),
d AS (SELECT *, (hxy / h - hx / h * hy / h) / sqrt((hxx / h - (hx / h) ** 2) * (hyy / h - (hy / h) ** 2)) AS e, CASE WHEN s - mid < -0.15 THEN 'FALLING' WHEN s - mid > 0.15 THEN 'RISING' WHEN s < 0.3 THEN 'BROKEN' ELSE 'STABLE' END AS trend, (l - s) / (sd + 1e-8) AS dis, CASE WHEN s - b > 0.05 THEN 'repairing' WHEN s - b < -0.05 THEN 'widening' ELSE 'stable' END AS direction,
  CASE WHEN abs(away) > 3 THEN 'CRITICAL' WHEN abs(away) > 2 OR cu / sqrt(m) > 2 THEN 'MAJOR' WHEN cu / sqrt(m) > 1 THEN 'MINOR' ELSE 'NONE' END AS severity FROM k)
SELECT pair_id, n, direction, severity, trend, coalesce(greatest(0, least(1, coalesce(dis, 0) / 4)) > 0.4 AND l > 0.0 AND direction <> 'widening', false) AS repair_likely, round(s, 6) + 0.0 AS short_corr, round(b, 6) + 0.0 AS before, round(mid, 6) + 0.0 AS mid_corr, round(l, 6) + 0.0 AS long_corr, round(e, 6) + 0.0 AS ewma_corr,
  round(dis, 5) + 0.0 AS dislocation, round(greatest(0, least(1, coalesce(dis, 0) / 4)), 5) + 0.0 AS score, round(cu, 5) + 0.0 AS cusum,
  round(CASE WHEN s IS NULL THEN 0.3 ELSE greatest(0, 1.0 - CASE severity WHEN 'CRITICAL' THEN 0.5 WHEN 'MAJOR' THEN 0.3 WHEN 'MINOR' THEN 0.1 ELSE 0 END - CASE WHEN s < 0.3 THEN 0.3 WHEN s < 0.5 THEN 0.15 ELSE 0 END
    - CASE trend WHEN 'BROKEN' THEN 0.2 WHEN 'FALLING' THEN 0.1 ELSE 0 END) END, 5)::DOUBLE + 0.0 AS health,
  CASE WHEN severity = 'CRITICAL' THEN 'EXIT' WHEN severity = 'MAJOR' THEN 'REDUCE' WHEN s < 0.3 THEN 'MONITOR' ELSE 'HOLD' END AS action FROM d""", "month")
def i13_correlation_state(spark, d):
    """Dislocation, break, health and action of the correlation of every pair."""
    r = pair_returns(spark, d).select("pair_id", "dt", F.col("x").alias("rx"), F.col("y").alias("ry"))
    found = dislocation.correlation_state(r, 12, 36, 60, 12, 1.0, 2.0, 0.3, 0.0)
    six = r6(found, "pair_id", "n", "direction", "severity", "trend", "repair_likely", "action", "dislocation", "score", "cusum", "health", six=["short_corr", "before", "mid_corr", "long_corr", "ewma_corr"])
    return six.withColumns({c: F.round(c, 5) + 0.0 for c in ("dislocation", "score", "cusum", "health")})
