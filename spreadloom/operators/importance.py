"""What features are worth to a model: the drop of its score when one of them is permuted, and its coefficients.

A permutation is a pairing of rows: the rows in one random order take the values of the rows in another. Orders come from
digests of the rows' keys, so they are the same on any partitioning and in any run. Places in an order are counted by
ranges of digests (blocks), within which a window numbers the rows; no task orders the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.operators.tables import settled

#: Hexadecimal digits of a digest that name its block: 256 blocks.
BLOCK_DIGITS = 2


def digest(label: str, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("/", F.lit(label), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def with_place(df: DataFrame, order: Column, ties: Sequence[str], place: str) -> DataFrame:
    """``place``: the row's number from 1 in the order of a digest. Counts of blocks are at most 256 rows."""
    keyed = df.withColumn("_h", order).withColumn("_block", F.substring("_h", 1, BLOCK_DIGITS))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = keyed.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy("_h", *ties))
    return keyed.withColumn(place, own).join(F.broadcast(counts), "_block").withColumn(place, F.col(place) + F.col("_before")).drop("_h", "_block", "_before")


def permuted(df: DataFrame, keys: Sequence[str], values: Sequence[str], seed: int) -> DataFrame:
    """The table with further columns ``other_<value>``: the values of the row that this one is paired with. Each row's
    values are given to exactly one row. ``keys`` name a row; of rows with equal keys the order of their values decides."""
    rows = with_place(df, digest(f"{seed}/to", keys), [*keys, *values], "_place")
    given = with_place(df.select(*keys, *values), digest(f"{seed}/from", keys), [*keys, *values], "_place")
    return rows.join(given.select("_place", *[F.col(v).alias(f"other_{v}") for v in values]), "_place").drop("_place")


def permutation_importance(
    data: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, score: Callable[[DataFrame], DataFrame], repeats: int, seed: int = 42
) -> DataFrame:
    """(feature, accuracy, brier, accuracy_drop, accuracy_sd, brier_rise, brier_sd): what a model loses when a feature's
    values are permuted, mean and sample deviation over repeats. ``score`` adds a column ``p``, the probability of label 1, to
    rows with the features. One pairing a repeat serves all features: a row is scored once as it is and once for each
    feature with that of its partner. Rows with a missing feature or label are left out before."""
    rows = settled(data.select(*keys, *features, F.col(label).cast("double").alias("_y")).dropna(subset=[*features, "_y"]))
    wrong = lambda p: (F.col("_y") != (F.col(p) >= 0.5).cast("double")).cast("double")
    spoilt = None
    for repeat in range(repeats):
        both = permuted(rows, keys, features, seed + repeat)
        sides = F.array(*[
            F.struct(F.lit(f).alias("feature"), *[F.col(f"other_{g}" if g == f else g).alias(g) for g in features]) for f in features
        ])
        one = both.select("_y", F.explode(sides).alias("s")).select("_y", "s.*")
        found = score(one).groupBy("feature").agg(F.avg(1 - wrong("p")).alias("a"), F.avg((F.col("p") - F.col("_y")) ** 2).alias("b"))
        found = found.withColumn("repeat", F.lit(repeat))
        spoilt = found if spoilt is None else spoilt.unionByName(found)
    whole = score(rows).agg(F.avg(1 - wrong("p")).alias("accuracy"), F.avg((F.col("p") - F.col("_y")) ** 2).alias("brier"))
    drops = spoilt.crossJoin(F.broadcast(whole))  # one row
    return drops.groupBy("feature").agg(
        F.max("accuracy").alias("accuracy"), F.max("brier").alias("brier"),
        F.avg(F.col("accuracy") - F.col("a")).alias("accuracy_drop"), F.stddev_samp(F.col("accuracy") - F.col("a")).alias("accuracy_sd"),
        F.avg(F.col("b") - F.col("brier")).alias("brier_rise"), F.stddev_samp(F.col("b") - F.col("brier")).alias("brier_sd"),
    )
