"""The state of every pair's correlation: how far it is from its long-run level, breaks of it, a health score and what to do.

All are frames of one pair in one shuffle and one aggregate; the exponentially weighted correlation of the last row is a
sum with weights by age, so no recursion is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadloom.functions.columns import clip, correlation, full, ordered, ratio, so_far, trailing, whole

KEY = "pair_id"


def correlation_state(
    returns: DataFrame, short: int = 20, long: int = 126, least: int = 200, half_life: float = 30, cusum: float = 3.0, alert: float = 2.5, stable: float = 0.5, repair: float = 0.7
) -> DataFrame:
    """One row a pair of (pair_id, dt, rx, ry): n; correlations of the last ``short`` rows, of those before, of three times as
    many, of the mean long frame, and with weights that halve every ``half_life`` rows; the trend; the dislocation (how many deviations of the short correlation the
    last one lies below the long level), its score from 0 to 1, direction, and whether a repair is likely; range of the
    cumulated short correlation in its own units, severity of the break, health from 0 to 1 and action. A pair with fewer
    than ``least`` rows has its count only, no break and a health of 0.3."""
    age = F.row_number().over(ordered(KEY).orderBy(F.desc("dt"))) - 1
    r = returns.where("rx IS NOT NULL AND ry IS NOT NULL").select(KEY, "dt", "rx", "ry", age.alias("age"))
    a, b, mid = trailing(short, KEY), trailing(long, KEY), trailing(3 * short, KEY)
    r = r.withColumns({"cs": full(correlation("rx", "ry", a), "rx", a, short), "cl": full(correlation("rx", "ry", b), "rx", b, long), "cm": full(correlation("rx", "ry", mid), "rx", mid, 3 * short)})
    of = whole(KEY)
    unit = F.try_divide(F.col("cs") - F.avg("cs").over(of), F.nullif(F.stddev_samp("cs").over(of), F.lit(0.0)))
    r = r.withColumn("u", unit).withColumn("path", F.sum("u").over(so_far(KEY)))
    w = F.pow(F.lit(0.5), F.col("age") / half_life)
    mean = lambda c: F.sum(w * c) / F.sum(w)
    x, y = F.col("rx"), F.col("ry")
    weighted = (mean(x * y) - mean(x) * mean(y)) / F.sqrt((mean(x * x) - mean(x) ** 2) * (mean(y * y) - mean(y) ** 2))
    at = lambda c, k: F.max(F.when(F.col("age") == k, F.col(c)))
    one = r.groupBy(KEY).agg(
        F.count("*").alias("n"), at("cs", 0).alias("short_corr"), at("cs", short).alias("before"), F.avg("cl").alias("long_corr"), F.stddev_samp("cs").alias("sd"),
        at("cm", 0).alias("mid_corr"), weighted.alias("ewma_corr"),
        F.count("cs").alias("m"), (F.max("path") - F.min("path")).alias("cusum"), at("u", 0).alias("away"),
    )
    enough = F.col("n") >= least
    one = one.withColumns({c: F.when(enough, F.col(c)) for c in ("short_corr", "before", "mid_corr", "long_corr", "ewma_corr", "cusum", "away")})
    one = one.withColumn("dislocation", (F.col("long_corr") - F.col("short_corr")) / (F.col("sd") + 1e-8))
    one = one.withColumn("score", F.coalesce(clip(F.col("dislocation") / 4, 0.0, 1.0), F.lit(0.0)))
    moved = F.col("short_corr") - F.col("before")
    one = one.withColumn("direction", F.when(moved > 0.05, "repairing").when(moved < -0.05, "widening").otherwise("stable"))
    likely = (F.col("score") > 0.4) & (F.col("long_corr") > repair) & (F.col("direction") != "widening")
    return judged(one.withColumn("repair_likely", F.coalesce(likely, F.lit(False))), cusum, alert, stable)


def judged(one: DataFrame, cusum: float, alert: float, stable: float) -> DataFrame:
    """Severity, health and action of rows with their numbers."""
    share, away, c = ratio("cusum", F.sqrt("m")), F.abs("away"), F.col("short_corr")
    severity = F.when(away > 1.5 * alert, "CRITICAL").when((away > alert) | (share > 2 * cusum), "MAJOR").when(share > cusum, "MINOR").otherwise("NONE")
    out = one.withColumn("severity", severity)
    gap, s = c - F.col("mid_corr"), F.col("severity")
    trend = F.when(gap < -0.15, "FALLING").when(gap > 0.15, "RISING").when(gap.isNotNull() & (c < 0.3), "BROKEN").otherwise("STABLE")
    out = out.withColumn("trend", trend)
    health = 1.0 - F.when(s == "CRITICAL", 0.5).when(s == "MAJOR", 0.3).when(s == "MINOR", 0.1).otherwise(0.0) - F.when(c < 0.3, 0.3).when(c < 0.5, 0.15).otherwise(0.0)
    health = health - F.when(F.col("trend") == "BROKEN", 0.2).when(F.col("trend") == "FALLING", 0.1).otherwise(0.0)
    action: Column = F.when(s == "CRITICAL", "EXIT").when(s == "MAJOR", "REDUCE").when(c < stable, "MONITOR").otherwise("HOLD")
    return out.select(
        KEY, "n", "short_corr", "before", "mid_corr", "long_corr", "ewma_corr", "trend", "dislocation", "score", "direction", "repair_likely", "cusum", "severity",
        F.when(c.isNull(), 0.3).otherwise(F.greatest(F.lit(0.0), health)).alias("health"), action.alias("action"),
    )
