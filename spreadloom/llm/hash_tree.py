"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A tree has regions, racks and shards with weights; a rack weighs what its shards do together, a region what its racks do.
Each rack of a row draws -ln(u) / weight from a hash of the row's key and the rack's path, and a region's draw is the least
of its racks', which is distributed as one draw with the region's weight. A row descends to the region with the least
draw, in it to the rack with the least draw, and in that to the shard with the least of the shards' own draws. A rack's
draw depends on its weight alone, a shard's on its own: if weights shift inside a rack whose weight stays, rows move only
inside it; if a rack's weight changes, rows move only from it, into it or inside it. A new shard in a rack of its own takes
rows only into itself; one in a rack that has others changes that rack's weight, and rows come to all of it.

Slots are numbered in blocks of rows by hash and offset by the counts of the blocks before, so that no shard, however
large, is numbered by one task. The text isn't shuffled. Defined results: a null text has size 1 and the checksum of
the empty text; rows with equal ids go to one shard and get a slot each; a null id is a key of its own; a very
long text is only measured; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

Tree = dict[str, dict[str, dict[int, float]]]

#: Region -> rack -> shard number -> weight.
EIGHT: Tree = {"r0": {"a": {0: 1.0, 1: 1.0}, "b": {2: 1.0, 3: 1.0}}, "r1": {"a": {4: 1.0, 5: 1.0}, "b": {6: 1.0, 7: 1.0}}}


def grown(tree: Tree, region: str, rack: str, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard."""
    out = {r: {k: dict(shards) for k, shards in racks.items()} for r, racks in tree.items()}
    out.setdefault(region, {}).setdefault(rack, {})[shard] = weight
    return out


def draw(key: Column, path: str, weight: float) -> Column:
    """An exponential draw with the weight as its rate, from 52 bits of a digest of the key and the shard's path."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + path))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / F.lit(float(weight))


def descend(key: Column, tree: Tree) -> Column:
    """The shard of a key. At each level the least draw wins; of equal draws the one that is named first, and of shards the
    one whose number is smaller. Only the shards of the rack that was reached draw."""
    regions, reached = [], []
    for r, racks in tree.items():
        of_racks = []
        for k, shards in racks.items():
            alive = {s: w for s, w in shards.items() if w > 0}
            if alive:
                place = len(reached)
                of_racks.append(F.struct(draw(key, f"{r}/{k}", sum(alive.values())).alias("draw"), F.lit(place).alias("place")))
                leaves = [F.struct(draw(key, f"{r}/{k}/{s}", w).alias("draw"), F.lit(s).alias("shard")) for s, w in alive.items()]
                reached.append(least(leaves)["shard"] if len(leaves) > 1 else F.lit(next(iter(alive))))
        if of_racks:
            regions.append(least(of_racks))
    rack, out = least(regions)["place"], reached[0]
    for place in range(1, len(reached)):
        out = F.when(rack == place, reached[place]).otherwise(out)
    return out


def least(draws: list[Column]) -> Column:
    return draws[0] if len(draws) == 1 else F.least(*draws)


def shard(docs: DataFrame, tree: Tree = EIGHT, more: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its size, checksum, shard, slot and its shard in the tree ``more`` (by default the tree and one
    more shard in a rack of its own in the last region)."""
    last = max(s for racks in tree.values() for shards in racks.values() for s in shards)
    more = more or grown(tree, [*tree][-1], "more", last + 1)
    blocks = max(64, 2 * partitions(docs.sparkSession))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        id_col,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, tree).alias("shard"),
        descend(key, more).alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(id_col), F.crc32(text.cast("binary"))), F.lit(blocks)).cast("int").alias("block"),
    )
    # At most shards * blocks rows: known before any data is read, so it may be broadcast.
    before = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "block").orderBy(F.col(id_col), "text_crc32", "size"))
    return rows.withColumn("own", own).join(F.broadcast(before), ["shard", "block"]).select(id_col, "size", "text_crc32", "law", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), "grown_shard")
