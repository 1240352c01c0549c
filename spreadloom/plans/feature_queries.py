"""Queries of the whole feature catalogue of instruments and pairs, and of the forward labels of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.functions import columns as x
from spreadloom.operators import pair_features as k
from spreadloom.plans.registry import register
from spreadloom.plans.table_queries import r6, sql6
from spreadloom.sources import panels


def panel(spark, d):
    """Pairs of segments: prices, volumes, and z of the log price ratio over 20 rows."""
    s = panels.segment_bars(spark, d)
    a, b = (s.select("dt", F.col("symbol").alias(f"s{c}"), F.col("close").alias(c), F.col("volume").alias(f"v{c}")) for c in "xy")
    pairs = a.join(b, "dt").where("sx < sy").select(F.concat_ws("/", "sx", "sy").alias("pair_id"), "dt", "x", "y", "vx", "vy", F.ln(F.col("x") / F.col("y")).alias("gap"))
    return pairs.select("pair_id", "dt", "x", "y", "vx", "vy", x.zscore("gap", x.trailing(20, "pair_id"), 20).alias("z"))


def frames(*sizes: int) -> str:
    return "WINDOW o AS (PARTITION BY pair_id ORDER BY dt), " + ", ".join(f"w{n} AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)


def when_full(value: str, of: str, n: int) -> str:
    return f"CASE WHEN count({of}) OVER w{n} >= {n} THEN {value} END"


PANEL = """
, g AS (SELECT a.symbol || '/' || b.symbol AS pair_id, a.dt, a.close AS x, b.close AS y, a.volume AS vx, b.volume AS vy, ln(a.close / b.close) AS gap
        FROM segs a JOIN segs b ON a.dt = b.dt AND a.symbol < b.symbol),
p AS (SELECT pair_id, dt, x, y, vx, vy, CASE WHEN count(gap) OVER w = 20 THEN (gap - avg(gap) OVER w) / nullif(stddev_pop(gap) OVER w, 0) END AS z
      FROM g WINDOW w AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, ln(x / lag(x) OVER o) AS rx, ln(y / lag(y) OVER o) AS ry, lag(z) OVER o AS b, z - lag(z) OVER o AS dz, row_number() OVER o AS place
      FROM p WINDOW o AS (PARTITION BY pair_id ORDER BY dt))
"""


@register(f"""
, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY dt)) AS r FROM bars),
f AS (SELECT symbol, dt, r AS ret_1d, ln(close / lag(close, 5) OVER o) AS ret_5d, ln(close / lag(close, 20) OVER o) AS ret_20d,
  CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 * sqrt(252) END AS vol_20d, CASE WHEN count(r) OVER w60 = 60 THEN stddev_samp(r) OVER w60 * sqrt(252) END AS vol_60d,
  CASE WHEN count(close) OVER w5 = 5 THEN (max(close) OVER w5 - min(close) OVER w5) / avg(close) OVER w5 END AS gap_5d, ln(close / lag(close, 60) OVER o) AS ret_60d,
  CASE WHEN count(volume) OVER w20 = 20 THEN avg(volume) OVER w5 / avg(volume) OVER w20 END AS volume_ratio
  FROM r WINDOW o AS (PARTITION BY symbol ORDER BY dt), w5 AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  w20 AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, vol_20d / nullif(vol_60d, 0) AS vol_ratio, ret_20d / nullif(vol_20d, 0) AS mom_20d, ret_60d / nullif(vol_60d, 0) AS mom_60d FROM f)
SELECT symbol, dt, {sql6(["ret_1d", "ret_5d", "ret_20d", "vol_20d", "vol_60d", "vol_ratio", "mom_20d", "mom_60d", "gap_5d", "volume_ratio"])} FROM h""")
def k01_instrument_catalogue(spark, d):
    f = k.instrument_features(panels.bars(spark, d))
    return r6(f, "symbol", "dt", six=f.columns[2:])


PAIR = {
    "z_abs": "abs(z)",
    "z_mean_20": when_full("avg(z) OVER w20", "z", 20),
    "z_std_20": when_full("stddev_samp(z) OVER w20", "z", 20),
    "z_mom_5": "z - lag(z, 5) OVER o",
    "z_mom_20": "z - lag(z, 20) OVER o",
    "z_ar1": when_full("regr_slope(z, b) OVER w21", "b", 21),
    "z_cross_zero_20": when_full("sum(crossed) OVER w19 / 20.0", "crossed", 19),
    "bb_pos_20": when_full("(z - avg(z) OVER w20) / nullif(stddev_samp(z) OVER w20, 0)", "z", 20),
    "bb_pos_60": when_full("(z - avg(z) OVER w60) / nullif(stddev_samp(z) OVER w60, 0)", "z", 60),
    "div_speed": "(z - lag(z, 3) OVER o) / 3",
    "entry_attempts_5": when_full("sum(up) OVER w5", "up", 5),
    "residual_skew": when_full("skewness(z) OVER w20 * 18 / sqrt(380)", "z", 20),
    "residual_kurt": when_full("(kurtosis(z) OVER w20 * 18 * 17 / 19 - 6) / 21", "z", 20),
    "rel_momentum": "(z - lag(z, 20) OVER o) / nullif(" + when_full("stddev_samp(dz) OVER w20", "dz", 20) + ", 0)",
    "corr_20": when_full("corr(rx, ry) OVER w20", "rx", 20),
    "corr_60": when_full("corr(rx, ry) OVER w60", "rx", 60),
    "hedge_ratio": when_full("regr_slope(y, x) OVER w60", "x", 60),
    "hr_stability": when_full("list_stddev_pop(hedges) / nullif(abs(list_avg(hedges)), 0)", "x", 60),
    "ar60": when_full("regr_slope(z, b) OVER w59", "b", 59),
    "spread_vol_20": when_full("stddev_pop(dz) OVER w20", "dz", 20),
    "spread_vol_ratio": when_full("stddev_pop(dz) OVER w20 / nullif(stddev_pop(dz) OVER w60, 0)", "dz", 60),
}
PAIR_OUT = [c for c in PAIR if c != "ar60"] + ["corr_trend", "half_life", "half_life_ratio"]


@register(f"""{PANEL}
, q1 AS (SELECT *, (sign(z) <> sign(b))::INT AS crossed, (abs(z) >= 2 AND abs(b) < 2)::INT AS up, {when_full("regr_slope(y, x) OVER w20", "x", 20)} AS beta20 FROM q {frames(20)}),
q2 AS (SELECT *, [{", ".join(f"lag(beta20, {5 * i}) OVER o" for i in range(9))}] AS hedges FROM q1 {frames(20)}),
f AS (SELECT pair_id, dt, z, {", ".join(f"{v} AS {c}" for c, v in PAIR.items())} FROM q2 {frames(5, 19, 20, 21, 59, 60)}),
h AS (SELECT *, corr_20 - corr_60 AS corr_trend, CASE WHEN ar60 > 0 AND ar60 < 1 THEN -ln(2) / ln(ar60) END AS half_life, CASE WHEN ar60 > 0 AND ar60 < 1 THEN -ln(2) / ln(ar60) / 30 END AS half_life_ratio FROM f)
SELECT pair_id, dt, {sql6(["z", *PAIR_OUT], 5)} FROM h""")
def k02_pair_catalogue(spark, d):
    return r6(k.pair_features(panel(spark, d)), "pair_id", "dt", six=["z", *PAIR_OUT], places=5)


REGIME = ["vol_regime", "vol_of_vol", "trend_slope", "mean_reversion_quality", "spread_persistence", "break_indicator", "market_stress", "liquidity_proxy"]


def sd(c: str, n: int) -> str:
    return when_full(f"stddev_samp({c}) OVER w{n}", c, n)


@register(f"""{PANEL}
, v AS (SELECT *, {sd("rx", 20)} * sqrt(252) AS vol_x, {when_full("stddev_pop(z) OVER w60", "z", 60)} AS sd60, {when_full("avg(z) OVER w60", "z", 60)} AS m60 FROM q {frames(20, 60)}),
sums AS (SELECT a.pair_id, a.dt, sum(b.z - a.m60) OVER (PARTITION BY a.pair_id, a.dt ORDER BY b.dt) AS s FROM v a JOIN v b ON a.pair_id = b.pair_id AND b.place BETWEEN a.place - 59 AND a.place WHERE a.m60 IS NOT NULL),
spans AS (SELECT pair_id, dt, max(s) - min(s) AS span FROM sums GROUP BY 1, 2),
f AS (SELECT v.*, ({sd("rx", 20)} + {sd("ry", 20)}) / nullif({sd("rx", 120)} + {sd("ry", 120)}, 0) AS vol_regime, {when_full("stddev_pop(vol_x) OVER w40", "vol_x", 40)} AS vol_of_vol,
  {when_full("coalesce(regr_slope(z, place) OVER w20 / nullif(stddev_pop(z) OVER w20, 0), 0)", "z", 20)} AS trend_slope, {when_full("regr_slope(z, b) OVER w60", "b", 60)} AS mean_reversion_quality,
  {when_full("corr(z, b) OVER w59", "b", 60)} AS spread_persistence, abs({sd("rx", 20)} - {sd("ry", 20)}) * sqrt(252) AS market_stress,
  {when_full("(avg(vx) OVER w5 + avg(vy) OVER w5) / (avg(vx) OVER w60 + avg(vy) OVER w60)", "vx", 5)} AS liquidity_proxy FROM v {frames(5, 20, 40, 59, 60, 120)}),
h AS (SELECT f.*, CASE WHEN f.sd60 < 1e-12 THEN 0 ELSE span / (f.sd60 * sqrt(60)) END AS break_indicator FROM f LEFT JOIN spans USING (pair_id, dt))
SELECT pair_id, dt, {sql6(REGIME, 5)} FROM h""")
def k03_regime_features(spark, d):
    return r6(k.regime_features(panel(spark, d)), "pair_id", "dt", six=REGIME, places=5)


@register(f"""{PANEL}
, e AS (SELECT *, abs(z) >= 2 AND abs(b) < 2 AS entry, CASE WHEN sign(z) <> sign(b) THEN lag(dt) OVER o END AS crossed, ((z - b) - (lag(z, 3) OVER o - lag(z, 4) OVER o)) / 3 AS jerk, sign(z) * (z - lead(z, 5) OVER o) AS gain
  FROM q WINDOW o AS (PARTITION BY pair_id ORDER BY dt)),
n AS (SELECT *, row_number() OVER o AS k, [{", ".join(f"struct_pack(p := lag(place, {i}) OVER o, g := lag(gain, {i}) OVER o)" for i in range(1, 8))}] AS past FROM e WHERE entry WINDOW o AS (PARTITION BY pair_id ORDER BY dt)),
t AS (SELECT e.*, sum(coalesce(entry, false)::INT) OVER u AS turn, last_value(crossed IGNORE NULLS) OVER u AS last_cross FROM e WINDOW u AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT n.pair_id, n.k AS turn, n.z AS entry_z, n.dt AS entry_dt, n.jerk AS entry_jerk, (len(list_filter(list_filter(past, lambda e: e.p + 5 <= place)[1:5], lambda e: e.g < 0)) > 0)::INT AS failed FROM n),
h AS (SELECT pair_id, dt, list(abs(z)) OVER (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS frame FROM q),
j AS (SELECT t.*, m.* EXCLUDE (pair_id, turn), sum((abs(z) >= 2)::INT) OVER (PARTITION BY t.pair_id, t.turn ORDER BY dt) AS bars FROM t JOIN m ON t.pair_id = m.pair_id AND t.turn = m.turn)
SELECT j.pair_id, j.dt, round(entry_z, 5) AS z_at_entry, date_diff('day', entry_dt, j.dt) AS days_since_breach, date_diff('day', last_cross, j.dt) AS days_since_cross, bars::BIGINT AS confirmation_bars, failed::BIGINT AS prior_failed,
  CASE WHEN len(list_filter(frame, lambda v: v IS NOT NULL)) = 60 THEN round(len(list_filter(frame, lambda v: v < abs(entry_z))) / 60.0, 5) END AS entry_percentile, round(entry_jerk, 5) + 0.0 AS entry_acceleration FROM j JOIN h USING (pair_id, dt)""")
def k04_signal_features(spark, d):
    f = k.signal_features(panel(spark, d))
    return r6(f, "pair_id", "dt", "days_since_breach", "days_since_cross", "confirmation_bars", "prior_failed", six=["z_at_entry", "entry_percentile", "entry_acceleration"], places=5)


@register(f"""{PANEL}
, a AS (SELECT *, lead(z, 10) OVER o AS z10, lead(z, 2) OVER o AS z2, lead(z, 12) OVER o AS z12, count(z) OVER f AS n, min(z) OVER f AS lo, max(z) OVER f AS hi, list(z) OVER l AS path
  FROM q WINDOW o AS (PARTITION BY pair_id ORDER BY dt), f AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), l AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)),
b AS (SELECT pair_id, dt, abs(z) >= 2 AS here, CASE WHEN n = 10 THEN ((CASE WHEN z > 0 THEN lo ELSE -hi END) <= 0.2 * abs(z))::INT END AS profit_target, (sign(z) * (z - z10) > 0.003)::INT AS profitable_net,
  CASE WHEN n = 10 THEN (greatest((CASE WHEN z > 0 THEN hi ELSE -lo END) - abs(z), 0) < 1.5)::INT END AS path_quality, (sign(z) * (z2 - z12) > sign(z) * (z - z10))::INT AS delay_better,
  coalesce(list_position(list_transform(path, lambda v: v * sign(z) >= 3.5), true), 60) AS bars_to_stop FROM a)
SELECT pair_id, dt, {", ".join(f"CASE WHEN here THEN {c} END AS {c}" for c in ("profit_target", "profitable_net", "path_quality", "delay_better"))}, CASE WHEN here THEN (CASE WHEN bars_to_stop = 0 THEN 60 ELSE bars_to_stop END)::INT END AS bars_to_stop,
  CASE WHEN here AND profitable_net IS NOT NULL AND path_quality IS NOT NULL THEN profitable_net * path_quality END AS size_full FROM b""")
def k05_trade_labels(spark, d):
    return k.trade_labels(panel(spark, d))


@register(f"""{PANEL}
, h AS (SELECT *, {when_full("regr_slope(y, x) OVER w60", "x", 60)} AS hedge, {when_full("regr_slope(z, b) OVER w60", "b", 60)} AS rho, {when_full("corr(z, b) OVER w60", "b", 60)} AS r, stddev_samp(z) OVER w60 AS sz, stddev_samp(b) OVER w60 AS sb FROM q {frames(60)}),
i AS (SELECT *, (rho - 1) / nullif(sz / nullif(sb, 0) * sqrt((1 - r * r) / 58), 0) AS df, CASE WHEN rho > 0 AND rho < 1 THEN -ln(2) / ln(rho) END AS hl FROM h),
a AS (SELECT *, count(dt) OVER f AS n, max(df) OVER f AS top, avg((df < -2.57)::INT::DOUBLE) OVER f AS share, max(hl) OVER f AS longest, max(hedge) OVER f AS most, min(hedge) OVER f AS least_, count(z) OVER f AS nz, avg(z) OVER f AS m, stddev_pop(z) OVER f AS s
  FROM i WINDOW f AS (PARTITION BY pair_id ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)),
sums AS (SELECT a.pair_id, a.dt, abs(sum(b.z - a.m) OVER (PARTITION BY a.pair_id, a.dt ORDER BY b.dt)) AS c FROM a JOIN q b ON a.pair_id = b.pair_id AND b.place BETWEEN a.place + 1 AND a.place + 30 WHERE a.nz = 30),
far AS (SELECT pair_id, dt, max(c) AS c FROM sums GROUP BY 1, 2)
SELECT pair_id, dt, CASE WHEN n = 30 THEN (top < -2.57)::INT END AS persistent, CASE WHEN n = 30 THEN round(share, 5) END AS strength, CASE WHEN n = 30 AND hl > 0 THEN (longest <= 2 * hl)::INT END AS half_life_stable,
  CASE WHEN n = 30 THEN (greatest(most - hedge, hedge - least_) / nullif(abs(hedge), 0) > 0.3)::INT END AS hedge_unstable,
  CASE WHEN n = 30 AND nz = 30 THEN (c / ((CASE WHEN s > 1e-10 THEN s ELSE 1 END) * sqrt(30)) > 1.2)::INT END AS broken FROM a LEFT JOIN far USING (pair_id, dt)""")
def k06_relationship_labels(spark, d):
    return r6(k.relationship_labels(panel(spark, d), break_at=1.2), "pair_id", "dt", "persistent", "half_life_stable", "hedge_unstable", "broken", six=["strength"], places=5)
