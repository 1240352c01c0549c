"""Queries of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.operators import clustering as cl
from spreadloom.operators import pairs as p
from spreadloom.plans.pair_queries import RETS, pairs_of
from spreadloom.plans.registry import register

KS = list(range(2, 6))
#: Distances of all symbols from correlations of returns.
TABLE = f"""{RETS}, cr AS (SELECT sym_x, sym_y, corr(rx, ry) AS corr FROM pr WHERE rx IS NOT NULL AND ry IS NOT NULL GROUP BY 1, 2),
dt AS MATERIALIZED (SELECT sym_x AS a, sym_y AS b, round(1 - abs(coalesce(corr, 0)), 9) AS d FROM cr UNION ALL SELECT sym_y, sym_x, round(1 - abs(coalesce(corr, 0)), 9) FROM cr),
c1 AS (SELECT a AS c FROM dt GROUP BY 1 ORDER BY round(sum(d), 9), 1 LIMIT 1),
c2 AS (SELECT a AS c FROM dt WHERE b IN (SELECT c FROM c1) ORDER BY d DESC, a LIMIT 1)"""
#: Farthest-first centres 1 to 5, and everyone's nearest of the first k.
NEAREST = TABLE + "".join(
    f", c{k} AS (SELECT a AS c FROM dt WHERE b IN ({' UNION ALL '.join(f'SELECT c FROM c{i}' for i in range(1, k))}) AND a NOT IN ({' UNION ALL '.join(f'SELECT c FROM c{i}' for i in range(1, k))}) GROUP BY 1 ORDER BY min(d) DESC, 1 LIMIT 1)"
    for k in range(3, 6)
) + ", cs AS (" + " UNION ALL ".join(f"SELECT {i} AS i, c FROM c{i}" for i in range(1, 6)) + "), km AS (SELECT k, c FROM cs, (VALUES (2), (3), (4), (5)) t(k) WHERE i <= k)," \
    " ms AS MATERIALIZED (SELECT k, symbol, arg_min(c, (d, c)) AS medoid FROM (SELECT k, a AS symbol, c, d FROM dt JOIN km ON b = c UNION ALL SELECT k, c, c, -1 FROM km) GROUP BY 1, 2)"
SILHOUETTE = """, mn AS (SELECT m.k, a AS symbol, m.medoid AS of, avg(d) AS d FROM dt JOIN ms m ON b = m.symbol GROUP BY 1, 2, 3),
io AS (SELECT m.k, m.symbol, m.medoid, max(CASE WHEN of = m.medoid THEN d END) AS i, min(CASE WHEN of <> m.medoid THEN d END) AS o FROM ms m LEFT JOIN mn ON mn.k = m.k AND mn.symbol = m.symbol GROUP BY 1, 2, 3),
sv AS (SELECT k, symbol, medoid, CASE WHEN o IS NULL THEN NULL WHEN i IS NULL OR greatest(i, o) = 0 THEN 0 ELSE (o - i) / greatest(i, o) END AS s FROM io)"""


def correlations(spark, d):
    return p.pair_correlation(pairs_of(spark, d), 0.0).select("sym_x", "sym_y", "corr")


@register(f"{NEAREST}{SILHOUETTE} SELECT k::INT AS k, symbol, medoid, round(s, 6) + 0.0 AS silhouette FROM sv", "month")
def i22_silhouettes(spark, d):
    """Everyone's nearest of the first 2 to 5 farthest symbols, and how well each is placed there."""
    table = cl.distance_table(correlations(spark, d))
    centres = cl.first_centres(table, max(KS))
    medoids = spark.createDataFrame([(k, c) for k in KS for c in centres[:k]], "k int, medoid string")
    return cl.silhouettes(table, cl.assigned(table, medoids)).withColumn("silhouette", F.round("silhouette", 6) + 0.0)


@register()
def i22_medoid_clusters(spark, d):
    """Clusters by medoids for the k of 2 to 5 with the best mean silhouette."""
    return cl.chosen_clusters(cl.distance_table(correlations(spark, d)), KS)


@register()
def i22_cluster_pairs(spark, d):
    """Pairs inside the chosen clusters."""
    corr = correlations(spark, d)
    return cl.pairs_within(corr, cl.chosen_clusters(cl.distance_table(corr), KS), 0.05)
