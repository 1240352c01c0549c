"""Spectra of series and pairs as Spark aggregates: segments and frequencies are rows, transforms are sums.

A discrete Fourier transform of one frequency is a sum over rows, so a segment's transform is an aggregate with partial
sums, and no series is collected. All parts keep the key of the first shuffle, so later groups and frames need none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import ordered

#: name -> lowest and highest frequency, in cycles a row, both inclusive.
Bands = dict[str, tuple[float, float]]


def placed(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, dt, k, values): rows without nulls, numbered from 0 in order of dt."""
    rows = df.select(key, "dt", *values).dropna(subset=values)
    return rows.withColumn("k", F.row_number().over(ordered(key)) - 1)


def transformed(df: DataFrame, key: str, values: list[str], length: int, step: int) -> DataFrame:
    """(key, segment, f, {v}_re, {v}_im): transforms of the full segments of each series, which begin every ``step`` rows.
    A segment's mean is taken out and a Hann window laid over it. f is the number of cycles in a segment."""
    first = F.greatest(F.lit(0), F.floor((F.col("k") - length) / step) + 1)
    of = placed(df, key, values).select(key, *values, "k", F.explode(F.sequence(first.cast("int"), F.floor(F.col("k") / step).cast("int"))).alias("segment"))
    own = Window.partitionBy(key, "segment")
    j = F.col("k") - F.col("segment") * step
    weight = 0.5 - 0.5 * F.cos(j * (2 * math.pi / length))
    flat = of.select(key, "segment", j.alias("j"), F.count("*").over(own).alias("n"), *[((F.col(v) - F.avg(v).over(own)) * weight).alias(v) for v in values])
    turned = flat.where(F.col("n") == length).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(length // 2))))
    angle = F.pmod(F.col("f") * F.col("j"), F.lit(length)) * (2 * math.pi / length)
    parts = [F.sum(F.col(v) * way).alias(f"{v}_{name}") for v in values for name, way in (("re", F.cos(angle)), ("im", -F.sin(angle)))]
    return turned.groupBy(key, "segment", "f").agg(*parts)


def cross_spectrum(pairs: DataFrame, length: int, step: int | None = None, key: str = "pair_id", x: str = "x", y: str = "y") -> DataFrame:
    """(key, f, segments, pxx, pyy, re, im) of each pair: powers and cross-power (conjugate of x times y) by frequency, Welch
    means over segments that overlap by half unless a step is given. A pair shorter than a segment has no rows."""
    t = transformed(pairs, key, [x, y], length, step or length // 2)
    a, b, c, d = (F.col(n) for n in (f"{x}_re", f"{x}_im", f"{y}_re", f"{y}_im"))
    return t.groupBy(key, "f").agg(
        F.count("*").alias("segments"), F.avg(a * a + b * b).alias("pxx"), F.avg(c * c + d * d).alias("pyy"), F.avg(a * c + b * d).alias("re"), F.avg(a * d - b * c).alias("im")
    )


def in_bands(rows: DataFrame, bands: Bands, frequency: Column) -> DataFrame:
    """Rows once for each band that holds their frequency; bands may overlap."""
    names = F.array_compact(F.array(*[F.when(frequency.between(low, high), name) for name, (low, high) in bands.items()]))
    return rows.withColumn("band", F.explode(names))


def coherence(pairs: DataFrame, length: int, bands: Bands, step: int | None = None, key: str = "pair_id", x: str = "x", y: str = "y") -> DataFrame:
    """(key, band, segments, coherence, phase, lag, power_x, power_y) of each pair: mean squared coherence of the band's
    frequencies, phase of its cross-power in radians (positive: y leads), that phase as rows at the band's mean frequency,
    and the shares of all power of either leg that lie in the band. One segment alone always coheres, so it gives null."""
    c = cross_spectrum(pairs, length, step, key, x, y)
    whole = Window.partitionBy(key)
    c = c.withColumns({"of_x": F.sum("pxx").over(whole), "of_y": F.sum("pyy").over(whole)})
    squared = F.when((F.col("pxx") * F.col("pyy") > 0) & (F.col("segments") > 1), (F.col("re") ** 2 + F.col("im") ** 2) / (F.col("pxx") * F.col("pyy")))
    banded = in_bands(c.withColumn("c", squared), bands, F.col("f") / length).groupBy(key, "band").agg(
        F.max("segments").alias("segments"), F.avg("c").alias("coherence"), F.atan2(F.sum("im"), F.sum("re")).alias("phase"), F.avg("f").alias("_f"),
        (F.sum("pxx") / F.nullif(F.max("of_x"), F.lit(0.0))).alias("power_x"), (F.sum("pyy") / F.nullif(F.max("of_y"), F.lit(0.0))).alias("power_y"),
    )
    lag = F.col("phase") * length / (2 * math.pi * F.nullif(F.col("_f"), F.lit(0.0)))
    return banded.select(key, "band", "segments", "coherence", "phase", lag.alias("lag"), "power_x", "power_y")


def haar_energy(df: DataFrame, value: str, levels: int, key: str = "symbol") -> DataFrame:
    """(key, level, shortest, longest, energy, share, amplitude, cycle): energy of the details of a Haar transform. The
    detail of a level is the difference of the sums of the two halves of a block of 2^level rows; blocks that the series
    doesn't fill are left out, and a level of fewer than two blocks' halves too. ``cycle`` marks half as much energy again
    as an even spread over the levels would give."""
    rows = placed(df, key, [value]).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    rows = rows.withColumn("total", F.sum(F.col(value) ** 2).over(Window.partitionBy(key)))
    at = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels)))).where("n >= 4 * shiftleft(1, level - 1)")
    sign = F.when(F.expr("shiftright(k, level - 1) % 2 = 0"), 1.0).otherwise(-1.0)
    blocks = at.groupBy(key, "level", F.expr("shiftright(k, level)").alias("block")).agg(F.count("*").alias("m"), F.sum(F.col(value) * sign).alias("s"), F.max("total").alias("total"))
    detail = F.col("s") / F.sqrt(F.expr("shiftleft(1, level)"))
    full = blocks.where("m = shiftleft(1, level)").groupBy(key, "level").agg(F.sum(detail**2).alias("energy"), F.avg(F.abs(detail)).alias("amplitude"), F.max("total").alias("total"))
    share = F.col("energy") / F.nullif(F.col("total"), F.lit(0.0))
    return full.select(
        key, "level", F.expr("shiftleft(1, level)").alias("shortest"), F.expr("shiftleft(1, level + 1)").alias("longest"), "energy", share.alias("share"), "amplitude", (share > 1.5 / levels).alias("cycle")
    )


def rolling_band_power(df: DataFrame, value: str, n: int, bands: Bands, key: str = "symbol") -> DataFrame:
    """(key, dt, band, power): share of the power of the last n rows that lies in a band, where there are n rows. The
    transform of a frame is the difference of two running sums of the turned series, whose common phase doesn't change
    a power; so a row costs the same whatever n is. The series' mean is taken out first, which keeps the sums small and
    is no part of any frequency above 0."""
    rows = placed(df, key, [value]).withColumn("v", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    turned = rows.withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(n // 2))))
    angle = F.pmod(F.col("f") * F.col("k"), F.lit(n)) * (2 * math.pi / n)
    line = Window.partitionBy(key, "f").orderBy("k")
    sums = turned.select(key, "dt", "k", "f", *[F.sum(F.col("v") * way).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c, way in (("re", F.cos(angle)), ("im", F.sin(angle)))])
    ago = lambda c: F.col(c) - F.coalesce(F.lag(c, n).over(line), F.lit(0.0))
    power = sums.select(key, "dt", "k", "f", (ago("re") ** 2 + ago("im") ** 2).alias("p")).where(F.col("k") >= n - 1)
    shared = power.withColumn("total", F.sum("p").over(Window.partitionBy(key, "k")))
    return in_bands(shared, bands, F.col("f") / n).groupBy(key, "dt", "band").agg((F.sum("p") / F.nullif(F.max("total"), F.lit(0.0))).alias("power"))
