"""Connected components of a table of links, by joins: labels spread to neighbours and jump to their labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of a link (a, b): the smallest node that can be reached. Links may repeat and may
    name a node twice; no links give no rows. Each round is a written table, so a lost executor costs no earlier round.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = labels.join(of_label, "label").select("node", F.least("label", "next").alias("label"), F.col("label").alias("was"))
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("at_b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("at_b").alias("near"))
        grown = stored(jumped.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.least("label", "near") < F.col("was")).alias("moved")), "labels")
        dropped(labels)
        labels = grown
        if not labels.where("moved").limit(1).count():
            dropped(both)
            return labels.select("node", "label")
