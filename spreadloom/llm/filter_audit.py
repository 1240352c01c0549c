"""Interactions of filters: what each of them removes in every order, by a walk over all subsets in Gray-code order.

Each document has a mask of the filters that it fails. The documents of a part are counted by mask, so a part has at
most 2^k cells, whatever its size. The walk starts with no filter and toggles one at a time: each cell counts how many
of its failed filters are active, and its documents leave the running survivors when that count leaves zero and come
back when it returns to it. The survivors of all 2^k subsets are kept; a step of an order is the difference of two.

Texts aren't shuffled, only their digests; copies of one text are added up by part, mask and labels before they meet, so
a text that a third of all rows hold is a few rows. Defined results: a null text is empty; a null source is the part
''; a null id is no smaller or larger than another, so its row is never a copy nor the first of copies; of rows that
repeat an id and a text all are first or none; each row counts, repeated ones too; a document without labels, or with
null ones, is neither good nor toxic, and one with several is what any of them says; texts are taken whole, of any
length; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from string import ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .quality_rules import SPACES, let

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> list[Column]:
    """The filters of a text, each true where it fails: too short (A), poor in words (B), shouting (C), symbols (D)."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct((n < 50).alias("A"), (F.size(F.array_distinct(words)) * 100 < n * 65).alias("B"))

    words = let(F.filter(F.split(text, SPACES), lambda w: w != ""), of_words)
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]+", ""))
    return [words["A"], words["B"], capitals * 100 > F.length(text) * 5, text.rlike(r"[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, filters: list[Column], id_col: str, part: Column, text: Column) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters; bit j is filter j, the last one copies."""
    bits = [F.when(f, F.lit(1 << j)).otherwise(F.lit(0)) for j, f in enumerate(filters)]
    mask = F.array(*bits) if bits else F.array(F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(text.cast("binary"))).alias("text"),
        F.aggregate(mask, F.lit(0), lambda a, b: a.bitwiseOR(b)).alias("mask"),
    )
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    named = rows.where("id IS NOT NULL").join(marked, "id", "left").fillna(0, ["good", "toxic"])
    unnamed = rows.where("id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    kind = ["text", "part", "mask", "good", "toxic"]
    by_id = named.unionByName(unnamed).groupBy("id", *kind).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("of_least"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("text"))
    copies = F.col("n") - F.col("unnamed") - F.when(first, F.col("of_least")).otherwise(0)
    sides = F.array(
        F.struct((F.col("n") - F.col("copies")).alias("n"), F.col("mask").alias("mask")),
        F.struct(F.col("copies").alias("n"), F.col("mask").bitwiseOR(F.lit(1 << len(filters))).alias("mask")),
    )
    both = by_text.withColumn("copies", copies).select("part", "good", "toxic", F.inline(sides)).where("n > 0")
    return both.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def walk(mask: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors of every subset of k filters: row s, of subset s, has what of each column of counts no filter of s
    removes. One filter is toggled a step, and only cells that fail it are touched."""
    survivors = np.zeros((1 << k, counts.shape[1]), np.int64)
    running, active, subset = counts.sum(axis=0), np.zeros(len(mask), np.int64), 0
    survivors[0] = running
    fails = [np.flatnonzero(mask >> j & 1) for j in range(k)]
    for i in range(1, 1 << k):
        j = (i & -i).bit_length() - 1
        subset ^= 1 << j
        at = fails[j]
        if subset >> j & 1:
            running = running - counts[at[active[at] == 0]].sum(axis=0)
            active[at] += 1
        else:
            active[at] -= 1
            running = running + counts[at[active[at] == 0]].sum(axis=0)
        survivors[subset] = running
    return survivors


def steps(part: str, mask: np.ndarray, counts: np.ndarray, k: int) -> pd.DataFrame:
    """Every order of the filters step by step, from the survivors of their subsets."""
    survivors, out, shapley = walk(mask, counts, k), [], np.zeros(k, np.int64)
    failing = [counts[mask >> j & 1 == 1, 0].sum() for j in range(k)]
    alone = [counts[mask == 1 << j, 0].sum() for j in range(k)]
    for order in permutations(range(k)):
        subset, name = 0, "".join(ascii_uppercase[j] for j in order)
        for step, j in enumerate(order, 1):
            lost = survivors[subset] - survivors[subset | 1 << j]
            subset |= 1 << j
            shapley[j] += lost[0]
            out.append((part, name, step, survivors[subset, 0], lost[0], failing[j] - lost[0], alone[j], lost[1], lost[2], j))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
    frame["shapley"] = shapley[frame["shapley"].to_numpy(int)]
    return frame


def interactions(
    docs: DataFrame, labels: DataFrame, filters: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row a part, order of all filters and step. ``filters`` are conditions on the columns of docs that hold where a
    document fails, by default the four of ``failures``; one more, the last, fails copies of the text of a smaller id.
    ``shapley`` is what a filter removes summed over all orders. k filters give k! orders, so they are to be few."""
    text = text_or_empty(text_col)
    own = failures(text) if filters is None else filters
    k = len(own) + 1

    def walked(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return steps(key[0], frame["mask"].to_numpy(np.int64), frame[["n", "good", "toxic"]].to_numpy(np.int64), k)

    return cells(docs, labels, own, id_col, F.col(part_col), text).groupBy("part").applyInPandas(walked, RESULT)


def orders(k: int) -> Iterator[str]:
    return map("".join, permutations(ascii_uppercase[:k]))


def duckdb_sql() -> str:
    """The five filters over ``documents`` and ``labels`` for DuckDB."""
    return rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
s AS (SELECT part, subset, coalesce(sum(n) FILTER (mask & subset = 0), 0) AS n, coalesce(sum(good) FILTER (mask & subset = 0), 0) AS good, coalesce(sum(toxic) FILTER (mask & subset = 0), 0) AS toxic
      FROM c, (SELECT unnest(range(32)) AS subset) GROUP BY 1, 2),
f AS (SELECT part, j, coalesce(sum(n) FILTER (mask & (1 << j) > 0), 0) AS failing, coalesce(sum(n) FILTER (mask = 1 << j), 0) AS alone FROM c, (SELECT unnest(range(5)) AS j) GROUP BY 1, 2),
o AS (SELECT unnest({list(orders(5))}) AS filter_order),
p AS (SELECT filter_order, step, ascii(filter_order[step]) - 65 AS j, list_sum(list_transform(range(1, step + 1), lambda i: 1 << (ascii(filter_order[i]) - 65)))::BIGINT AS after
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT b.part, filter_order, step, p.j, b.n AS kept, a.n - b.n AS removed, failing - (a.n - b.n) AS redundant, alone AS unique_fails, a.good - b.good AS good_lost, a.toxic - b.toxic AS toxic_lost
      FROM p JOIN s b ON b.subset = after JOIN s a ON a.subset = after - (1 << p.j) AND a.part = b.part JOIN f ON f.part = b.part AND f.j = p.j)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, j))::BIGINT AS shapley FROM r
"""
