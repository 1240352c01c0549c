"""How the words of a source depart from those of its language and of the other sources: ranks of count cells.

Terms are counted by language, source and term, first in each task, as bytes: a term holds no ASCII but letters, so a
translation of bytes and a split at spaces give the terms. A task holds at most ``MOST`` counts at once and then passes
them on, Spark adds them up. A term and a language have one row with the counts of all its sources.
Whatever depends on counts alone is worked out once for a cell, the terms that share their counts:

- terms of a group: cells of (count in the group, count in the language). The value is evaluated for a cell, equal
  values are merged, and values are ranked by the number of terms before them, so only the terms of values that reach
  the wanted ranks are expanded, in the order of their UTF-8 bytes.
- pairs of sources: terms with the same counts in the same sources are added up first. Cells of (count here, count
  there) hold the terms that both have; terms that only one has, or none, follow by difference from the counts of each
  source and the number of kept terms, and are never listed.

Groups are few rows against documents. A table of them is broadcast only up to ``FEW`` rows, beyond that the join is
salted. The values of all cells are whole numbers, products in decimals of 38 digits.

Defined results: null texts, languages and sources are ''; a document without terms makes its group occur; repeated
rows count as documents of their own; texts are taken whole, of any length; a group whose language keeps no term has
pairs of value 0 and no terms; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, prepare, slices, stored

#: Fixed value: what a term is made of, for SQL.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows up to which a table of groups is broadcast.
FEW = 100_000
SALTS = 32
#: Counts that a task holds before it passes them on.
MOST = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of terms as they are counted, all others as spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of batches (lang, source, text in UTF-8): sums over the documents of a task, in parts."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> pa.RecordBatch:
        columns = [[], [], [], [], []]
        for (lang, source), (n, docs) in seen.items():
            columns[0] += [lang] * len(n)
            columns[1] += [source] * len(n)
            columns[2] += [term.decode() for term in n]
            columns[3] += n.values()
            columns[4] += [docs[term] for term in n]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2)], ["lang", "source", "term", "n", "docs"])

    for batch in (part for whole in batches for part in slices(whole, 2)):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            terms = Counter(text.translate(PLAIN).split())
            n.update(terms)
            docs.update(terms.keys())
        if sum(len(n) for n, _ in seen.values()) > MOST:
            yield passed_on()
    yield passed_on()


def term_counts(docs: DataFrame, least_docs: int, lang: Column, source: Column, text: Column) -> DataFrame:
    """(lang, term, total, counts): terms in at least so many documents of their language; counts is an array of (source,
    n)."""
    seen = docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text")).mapInArrow(counted, COUNTED)
    by_source = seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_lang = by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts")
    )
    return by_lang.where(F.col("docs") >= least_docs).drop("docs")


def groups(docs: DataFrame, kept: DataFrame, lang: Column, source: Column) -> DataFrame:
    """(lang, source, n_group, n_lang, v): every group that occurs, its occurrences of kept terms, those of its language,
    and the number of kept terms."""
    whole = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    own = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    every = docs.select(lang.alias("lang"), source.alias("source")).distinct()
    return every.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["n_group", "n_lang", "v"])


def with_group(rows: DataFrame, table: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Rows joined to their row in a table of groups. A large table is joined by key and salt, so that the rows of a hot
    group go to many tasks."""
    if table.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(table), keys)
    dealt = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(dealt, [*keys, "_salt"]).drop("_salt")


def share(count: str, of: str, v: str) -> str:
    """SQL of a smoothed share in parts of 10^9. The product is a decimal, which no count overflows."""
    return f"(1 + (CAST(1000000000 AS DECIMAL(19, 0)) * CAST({count} + 1 AS DECIMAL(19, 0))) DIV CAST({of} + {v} AS DECIMAL(19, 0)))"


def gap(p: str, q: str) -> str:
    """SQL of the value of a cell."""
    return f"(({p} - {q}) * ({p} - {q}) DIV {q})"


def top_terms(kept: DataFrame, of_group: DataFrame, ranks: int) -> DataFrame:
    """The terms that a group has more of than its language, the first so many by value."""
    rows = kept.select("lang", "term", "total", F.inline("counts"))
    cells = with_group(rows.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("terms")), of_group, ["lang", "source"], F.col("total"))
    cells = cells.withColumns({"p": F.expr(share("n", "n_group", "v")), "q": F.expr(share("total", "n_lang", "v"))}).where("p > q")
    cells = stored(cells.select("lang", "source", "n", "total", "terms", F.expr(gap("p", "q")).alias("value")), "cells")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    first = values.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= ranks).drop("_k")
    before = F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < ranks).drop("terms")
    # At most ``ranks`` values a group, the least of them bounds the cells whose terms are looked at.
    bounds = first.groupBy("lang", "source").agg(F.min("value").alias("least"))
    limits = stored(of_group.join(bounds, ["lang", "source"]), "limits")
    near = with_group(rows, limits, ["lang", "source"], F.col("term"))
    near = near.withColumns({"p": F.expr(share("n", "n_group", "v")), "q": F.expr(share("total", "n_lang", "v"))}).where("p > q")
    near = near.select("lang", "source", "term", F.expr(gap("p", "q")).alias("value"), "least").where("value >= least")
    place = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))
    placed = near.withColumn("place", place).where(F.col("place") <= ranks)
    return placed.join(first, ["lang", "source", "value"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", (F.col("before") + F.col("place")).alias("rank")
    ).where(F.col("rank") <= ranks)


def pair_values(kept: DataFrame, of_group: DataFrame) -> DataFrame:
    """Every group against every other source of its language: the values of all kept terms, added up."""
    profiles = kept.groupBy("lang", "counts").agg(F.count("*").alias("terms"))
    # Both ends of a pair of sources come from the two that a term has, the smaller name first.
    pairs = F.flatten(
        F.transform("counts", lambda a, i: F.transform(
            F.slice("counts", i + 2, F.size("counts")),
            lambda b: F.struct(a["source"].alias("a"), b["source"].alias("b"), a["n"].alias("n_a"), b["n"].alias("n_b")),
        ))
    )
    both = profiles.select("lang", "terms", F.inline(pairs)).groupBy("lang", "a", "b", "n_a", "n_b").agg(F.sum("terms").alias("terms"))
    one = kept.select("lang", F.inline("counts")).groupBy("lang", F.col("source").alias("a"), F.col("n").alias("n_a")).agg(F.count("*").alias("terms"))
    ends = of_group.select("lang", F.col("source").alias("a"), F.col("n_group").alias("of_a"), "v")
    others = of_group.select("lang", F.col("source").alias("b"), F.col("n_group").alias("of_b"))
    each = stored(ends.join(others, "lang").where("a <> b"), "pairs")

    p, q, p0, q0 = share("n_a", "of_a", "v"), share("n_b", "of_b", "v"), share("0", "of_a", "v"), share("0", "of_b", "v")
    none = gap("p0", "q0")

    def summed(cells: DataFrame, value: str) -> DataFrame:
        return cells.groupBy("lang", "a", "b").agg(F.sum(F.expr(f"CAST({value} AS DECIMAL(19, 0)) * terms")).alias("value"))

    # Terms of both: their own value, less what the sums over the terms of each end and over all terms count for them.
    cells = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"), "terms"))
    cells = with_group(cells, each, ["lang", "a", "b"], F.struct("n_a", "n_b"))
    cells = cells.withColumns({"p": F.expr(p), "q": F.expr(q), "p0": F.expr(p0), "q0": F.expr(q0)})
    shared = summed(cells, f"({gap('p', 'q')} - {gap('p', 'q0')} - {gap('p0', 'q')} + {none})")
    here = with_pairs(one, each, "a").withColumns({"p": F.expr(p), "p0": F.expr(p0), "q0": F.expr(q0)})
    there = with_pairs(one.withColumnsRenamed({"a": "b", "n_a": "n_b"}), each, "b").withColumns({"q": F.expr(q), "p0": F.expr(p0), "q0": F.expr(q0)})
    of_here, of_there = summed(here, f"({gap('p', 'q0')} - {none})"), summed(there, f"({gap('p0', 'q')} - {none})")
    nowhere = each.withColumns({"p0": F.expr(p0), "q0": F.expr(q0)}).where("v > 0").withColumn("terms", F.col("v"))
    empty = each.where("v = 0").select("lang", "a", "b", F.lit(0).cast("decimal(38,0)").alias("value"))
    parts = [shared, of_here, of_there, summed(nowhere, none), empty]
    total = reduce(DataFrame.unionByName, [x.withColumn("value", F.col("value").cast("decimal(38,0)")) for x in parts])
    total = total.groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b"))
    return total.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", rank.cast("long").alias("rank"))


def with_pairs(one: DataFrame, each: DataFrame, end: str) -> DataFrame:
    """The counts of a source with every pair that it is an end of: the partners of a source as one row, then expanded."""
    other = "b" if end == "a" else "a"
    partners = each.groupBy("lang", end).agg(F.collect_list(F.struct(other, "of_a", "of_b", "v")).alias("_partners"))
    return with_group(one, partners, ["lang", end], F.col(one.columns[2])).select(*one.columns, F.inline("_partners"))


def divergence(
    docs: DataFrame, least_docs: int = 3, ranks: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of a group's language by how far the group is from them
    (part ``pair``, all), and the terms it has more of than its language (part ``term``, the first ``ranks``)."""
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col))
    prepare(docs.sparkSession)
    kept = stored(term_counts(docs, least_docs, lang, source, text), "terms")
    of_group = stored(groups(docs, kept, lang, source), "groups")
    found = pair_values(kept, of_group).unionByName(top_terms(kept, of_group, ranks).withColumn("rank", F.col("rank").cast("long")))
    out = stored(found.withColumn("rank", F.col("rank").cast("int")), "divergence")
    dropped(kept)
    dropped(of_group)
    return out


def duckdb_sql(least_docs: int = 3, ranks: int = 200) -> str:
    """The same over ``documents`` for DuckDB."""
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS words FROM documents),
w AS (SELECT lang, source, row, unnest(words) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM w GROUP BY 1, 2, 3),
k AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2 HAVING sum(docs) >= {least_docs}),
l AS (SELECT lang, sum(total)::HUGEINT AS n_lang, count(*) AS v FROM k GROUP BY 1),
o AS (SELECT lang, source, term, n, total FROM c JOIN k USING (lang, term)),
g AS (SELECT lang, source, coalesce(s, 0)::HUGEINT AS n_group, coalesce(n_lang, 0)::HUGEINT AS n_lang, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS s FROM o GROUP BY 1, 2) USING (lang, source) LEFT JOIN l USING (lang)),
e AS (SELECT g.lang, g.source, term, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (n_group + v) AS p FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
q AS (SELECT lang, source, term, 1 + (1000000000::HUGEINT * (n + 1)) // (n_group + v) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (n_lang + v) AS q FROM o JOIN g USING (lang, source)),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM q WHERE p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM every
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= {ranks}
"""
