"""Clusters of symbols by medoids on one shared table of distances, for several numbers of clusters at once, and the choice
among these.

The table of distances is computed once, as an aggregate over the pairs panel, and written. Centres are first taken
farthest from those before (the first k of one sequence serve every k), then each cluster's medoid and each symbol's
nearest medoid are found in turn, for all k in one job. Distances and sums are rounded before they are compared, so that
the order in which Spark adds them up changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.operators.tables import settled

PLACES = 9


def distance_table(pairs: DataFrame) -> DataFrame:
    """(a, b, distance), both ways, from (sym_x, sym_y, corr): 1 - |corr|, and 1 where there is no correlation."""
    one = pairs.select(F.col("sym_x").alias("a"), F.col("sym_y").alias("b"), F.round(1 - F.abs(F.coalesce("corr", F.lit(0.0))), PLACES).alias("distance"))
    return settled(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")))


def first_centres(table: DataFrame, most: int) -> list[str]:
    """At most so many symbols: the one with the least sum of distances, then always the one farthest from those before;
    ties by name. One short job a centre."""
    sums = table.groupBy("a").agg(F.round(F.sum("distance"), PLACES).alias("s")).orderBy("s", "a").limit(1).collect()
    out = [r["a"] for r in sums]
    while out and len(out) < most:
        near = table.where(F.col("b").isin(out) & ~F.col("a").isin(out)).groupBy("a").agg(F.min("distance").alias("d"))
        found = near.orderBy(F.desc("d"), "a").limit(1).collect()
        if not found:
            break
        out.append(found[0]["a"])
    return out


def assigned(table: DataFrame, medoids: DataFrame) -> DataFrame:
    """(k, symbol, medoid): every symbol's nearest medoid of each k; a medoid is its own, ties by name."""
    near = table.join(medoids.withColumnRenamed("medoid", "b"), "b").select("k", F.col("a").alias("symbol"), F.col("b").alias("medoid"), "distance")
    own = medoids.select("k", F.col("medoid").alias("symbol"), "medoid", F.lit(-1.0).alias("distance"))
    return near.unionByName(own).groupBy("k", "symbol").agg(F.min(F.struct("distance", "medoid"))["medoid"].alias("medoid"))


def centred(table: DataFrame, members: DataFrame) -> DataFrame:
    """(k, medoid): of each cluster the member with the least sum of distances to the others, ties by name."""
    a, b = members.select("k", "medoid", F.col("symbol").alias("a")), members.select("k", "medoid", F.col("symbol").alias("b"))
    inside = table.join(a, "a").join(b, ["k", "medoid", "b"]).groupBy("k", "medoid", "a").agg(F.round(F.sum("distance"), PLACES).alias("s"))
    alone = members.select("k", "medoid", F.col("symbol").alias("a")).join(inside, ["k", "medoid", "a"], "left_anti").withColumn("s", F.lit(0.0))
    return inside.unionByName(alone).groupBy("k", "medoid").agg(F.min(F.struct("s", "a"))["a"].alias("next")).select("k", F.col("next").alias("medoid"))


def medoid_clusters(table: DataFrame, ks: list[int], rounds: int = 20) -> DataFrame:
    """(k, symbol, medoid) for every k that the number of symbols allows; ends when no medoid changes, or after so many
    rounds."""
    spark = table.sparkSession
    centres = first_centres(table, max(ks))
    medoids = {(k, c) for k in ks if k <= len(centres) for c in centres[:k]}
    for _ in range(rounds):
        members = assigned(table, spark.createDataFrame(sorted(medoids), "k int, medoid string"))
        moved = {tuple(r) for r in centred(table, members).collect()}  # k rows for each k
        if moved == medoids:
            return members
        medoids = moved
    return assigned(table, spark.createDataFrame(sorted(medoids), "k int, medoid string"))


def silhouettes(table: DataFrame, members: DataFrame) -> DataFrame:
    """(k, symbol, medoid, silhouette): how much nearer a symbol is to its cluster than to the nearest other one, between -1
    and 1; 0 for a cluster of one, null if there is no other cluster."""
    to = members.select("k", F.col("symbol").alias("b"), F.col("medoid").alias("of"))
    mean = table.join(to, "b").groupBy("k", "a", "of").agg(F.avg("distance").alias("d"))
    own = members.join(mean.withColumnRenamed("a", "symbol"), ["k", "symbol"], "left").groupBy("k", "symbol", "medoid").agg(
        F.max(F.when(F.col("of") == F.col("medoid"), F.col("d"))).alias("inner"), F.min(F.when(F.col("of") != F.col("medoid"), F.col("d"))).alias("outer")
    )
    widest = F.greatest("inner", "outer")
    value = F.when(F.col("outer").isNull(), F.lit(None)).when(F.col("inner").isNull() | (widest == 0), 0.0).otherwise((F.col("outer") - F.col("inner")) / widest)
    return own.select("k", "symbol", "medoid", value.cast("double").alias("silhouette"))


def scored(values: DataFrame) -> DataFrame:
    """(k, silhouette, n_clusters, chosen): the mean silhouette of each k; the largest is chosen, of equal ones the least k."""
    s = values.groupBy("k").agg(F.round(F.avg("silhouette"), PLACES).alias("silhouette"), F.countDistinct("medoid").alias("n_clusters"))
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("silhouette"), "k")  # one row a k
    return s.withColumn("chosen", F.row_number().over(best) == 1)


def chosen_clusters(table: DataFrame, ks: list[int]) -> DataFrame:
    """(k, symbol, medoid, silhouette) of the k with the best mean silhouette."""
    values = settled(silhouettes(table, medoid_clusters(table, ks)))
    return values.join(scored(values).where("chosen").select("k"), "k")


def pairs_within(pairs: DataFrame, clusters: DataFrame, least_corr: float) -> DataFrame:
    """Pairs (sym_x, sym_y, corr) of one cluster with at least so much correlation, with its medoid."""
    of = lambda leg: clusters.select(F.col("symbol").alias(leg), "medoid")
    return pairs.where(F.abs("corr") >= least_corr).join(of("sym_x"), "sym_x").join(of("sym_y"), ["sym_y", "medoid"]).select("medoid", "sym_x", "sym_y", "corr")
