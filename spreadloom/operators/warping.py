"""The nearest partner of every symbol by time warping, without warping every pair.

Each pair has two cheap bounds, sums over its rows: what lies outside the other leg's envelope (a frame of the band) is at
least the distance, the straight path is at most it. The pair with the least lower bound of a symbol is warped first,
which gives each symbol a distance to beat; of the rest only pairs whose lower bound doesn't exceed that of one of their
symbols are warped. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import ordered, whole
from spreadloom.operators.sequential import time_warping
from spreadloom.operators.tables import settled


def standard(c: str) -> Column:
    """A leg less its mean in units of its deviation; of a constant leg the difference alone."""
    w = whole("pair_id")
    sd = F.stddev_pop(c).over(w)
    return (F.col(c) - F.avg(c).over(w)) / F.when(sd > 0, sd).otherwise(1.0)


def bounds(pairs: DataFrame, band: int) -> DataFrame:
    """(pair_id, sym_x, sym_y, low, high): bounds of the warped distance of each pair's standardised legs, from (pair_id,
    sym_x, sym_y, dt, x, y); both legs have every date."""
    z = pairs.select("pair_id", "sym_x", "sym_y", "dt", standard("x").alias("x"), standard("y").alias("y"))
    near = ordered("pair_id").rowsBetween(-band, band)
    z = z.withColumns({f"{c}_{name}": f(c).over(near) for c in ("x", "y") for name, f in (("top", F.max), ("bottom", F.min))})
    outside = lambda c, o: F.greatest(F.col(c) - F.col(f"{o}_top"), F.col(f"{o}_bottom") - F.col(c), F.lit(0.0))
    sums = z.groupBy("pair_id", "sym_x", "sym_y").agg(
        F.sum(outside("x", "y")).alias("a"), F.sum(outside("y", "x")).alias("b"), F.sum(F.abs(F.col("x") - F.col("y"))).alias("high")
    )
    low = F.greatest("a", "b")
    return sums.select("pair_id", "sym_x", "sym_y", (low - 1e-9 * (1 + low)).alias("low"), "high")  # below what rounding does


def by_symbol(pairs: DataFrame, *columns: str) -> DataFrame:
    """Every pair once for each of its symbols, with the other one."""
    a = pairs.select(F.col("sym_x").alias("symbol"), F.col("sym_y").alias("other"), "pair_id", *columns)
    return a.unionByName(pairs.select(F.col("sym_y").alias("symbol"), F.col("sym_x").alias("other"), "pair_id", *columns))


def nearest_by_warping(pairs: DataFrame, band: int = 10) -> DataFrame:
    """(symbol, nearest, dtw, n_pairs, n_warped): the partner with the least warped distance, ties by name, and of how many
    of a symbol's pairs the distance was worked out."""
    limits = settled(bounds(pairs, band))
    first = Window.partitionBy("symbol").orderBy("low", "other")
    chosen = by_symbol(limits, "low").withColumn("_k", F.row_number().over(first)).where("_k = 1").select("pair_id").distinct()
    legs = limits.select("pair_id", "sym_x", "sym_y")
    done = settled(time_warping(pairs.join(chosen, "pair_id", "left_semi"), band).join(legs, "pair_id"))
    beat = by_symbol(limits, F.col("high").alias("d")).unionByName(by_symbol(done, F.col("dtw").alias("d"))).groupBy("symbol").agg(F.min("d").alias("beat"))
    left = by_symbol(limits, "low").join(beat, "symbol").where("low <= beat").select("pair_id").distinct().join(done, "pair_id", "left_anti")
    more = time_warping(pairs.join(left, "pair_id", "left_semi"), band).join(legs, "pair_id")
    found = by_symbol(done.unionByName(more), "dtw").groupBy("symbol").agg(F.min(F.struct("dtw", "other")).alias("best"), F.count("*").alias("n_warped"))
    every = by_symbol(limits).groupBy("symbol").agg(F.count("*").alias("n_pairs"))
    return found.join(every, "symbol").select("symbol", F.col("best.other").alias("nearest"), F.col("best.dtw").alias("dtw"), "n_pairs", "n_warped")
