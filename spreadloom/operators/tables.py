"""Filters, enrichment and reconcile joins, ranking, deduplication and set operations on tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import pair_key


def sliced(df: DataFrame, start: str | None = None, end: str | None = None, at: str = "dt") -> DataFrame:
    """Inclusive on both ends; a null bound is open. The comparison reaches the scan."""
    if start is not None:
        df = df.where(F.col(at) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(at) <= F.lit(end).cast("date"))
    return df


def first_present(df: DataFrame, candidates: Sequence[str], name: str = "price") -> DataFrame:
    """The first of the candidate columns that the table has, coalesced in their order."""
    have = [c for c in candidates if c in df.columns]
    return df.withColumn(name, F.coalesce(*have) if have else F.lit(None).cast("double"))


def wide(df: DataFrame, index: str, columns: str, value: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(index).pivot(columns, list(names)).agg(F.max_by(value, index))


def long(df: DataFrame, index: str, names: Sequence[str], column: str = "symbol", value: str = "value") -> DataFrame:
    return df.unpivot(index, list(names), column, value).where(F.col(value).isNotNull())


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``reasons``: the names of all rules that hold, in order; ``eligible`` if none does."""
    out = df.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])))
    return out.withColumn("eligible", F.size("reasons") == 0)


def first_reason(rules: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])


def enriched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a table with one row a key; several rows of a key are an error of the right table, shown as a count."""
    w = Window.partitionBy(*on)
    one = right.withColumn("n_matches", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(*[c for c in right.columns if c not in on]))).where("_k = 1").drop("_k")
    return left.join(one, list(on), "left")


def reconciled(internal: DataFrame, broker: DataFrame, key: str, qty: str, tol: float = 1e-9, critical: float = 0.05) -> DataFrame:
    """Full outer join of two position tables, classified."""
    a, b = internal.select(key, F.col(qty).alias("qty_internal")), broker.select(key, F.col(qty).alias("qty_broker"))
    x, y = F.col("qty_internal"), F.col("qty_broker")
    gap = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y))
    kind = (
        F.when(y.isNull(), "orphan").when(x.isNull(), "unexpected").when(F.signum(x) != F.signum(y), "side_mismatch").when(F.abs(x - y) <= tol, "match").when(gap > critical, "quantity_critical").otherwise("quantity_mismatch")
    )
    return a.join(b, key, "full_outer").select(key, "qty_internal", "qty_broker", kind.alias("status"))


def rule_hits(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric rows (rule_id, entity, value) that break a rule (rule_id, threshold, low_is_bad, severity). Rules are few."""
    bad = F.when(F.col("low_is_bad"), F.col("value") < F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return metrics.join(rules, "rule_id").where(bad)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle, too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def settled(df: DataFrame) -> DataFrame:
    """Written to the session's checkpoint folder, where there is one, so that what reads it twice doesn't compute it twice;
    without such a folder as it is."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df


def cumulated(counts: DataFrame, value: str, n: str = "n", ranges: int = 64) -> DataFrame:
    """(value, n) of distinct values with ``upto``, the sum of n of all values up to it, and ``range``, the range of values it
    is in. A range is one task's window, so no task orders the whole table; bounds of ranges are one row, sums of ranges at
    most ``ranges`` rows."""
    cuts = counts.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    at = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    own = counts.where(F.col(value).isNotNull()).crossJoin(F.broadcast(cuts)).withColumn("range", at).drop("_cuts")
    sums = own.groupBy("range").agg(F.sum(n).alias("_s"))
    before = sums.select("range", (F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("_s")).alias("_before"))
    within = F.sum(n).over(Window.partitionBy("range").orderBy(value))
    return own.join(F.broadcast(before), "range").withColumn("upto", within + F.col("_before")).drop("_before")


def ranked(df: DataFrame, value: Column, key: str) -> DataFrame:
    """``rank`` of each row by value, the largest first and ties by key, and ``n_ranked``, the number of rows with a value. A
    row without one has no rank. Only rows of the same value are ordered in one window."""
    own = df.withColumn("_v", value)
    counts = own.groupBy("_v").agg(F.count("_v").alias("n"))
    total = counts.agg(F.sum("n").alias("n_ranked"))
    places = cumulated(counts, "_v").crossJoin(F.broadcast(total)).select("_v", "n_ranked", (F.col("n_ranked") - F.col("upto")).alias("_above"))
    apart = F.when(F.col("_v").isNull(), F.pmod(F.xxhash64(key), F.lit(1024)))  # rows without a value have no rank: not one task
    tie = F.row_number().over(Window.partitionBy("_v", apart).orderBy(key))
    return own.join(places, "_v", "left").withColumn("rank", (F.col("_above") + tie).cast("int")).drop("_v", "_above")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per(df, keys, order, 1).drop("place")


def deduped_pairs(df: DataFrame, x: str, y: str, order: Sequence[Column]) -> DataFrame:
    """One row an unordered pair, the best by the order."""
    return latest(df.withColumn("pair_key", pair_key(x, y)), ["pair_key"], order)


def dominated(a: np.ndarray, by: np.ndarray, step: int = 512) -> np.ndarray:
    """Which rows of a some row of ``by`` dominates: nowhere smaller and somewhere larger."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), step):
        part = a[i : i + step, None, :]
        for j in range(0, len(by), 4 * step):
            other = by[None, j : j + 4 * step, :]
            out[i : i + step] |= ((other >= part).all(2) & (other > part).any(2)).any(1)
    return out


def local_fronts(points: DataFrame) -> DataFrame:
    """The front of each partition; a task holds its front and one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front, names = None, None
        for batch in batches:
            names, new = batch.columns, batch.to_numpy(float)
            new = new[~dominated(new, new)]
            if front is not None:
                new = new[~dominated(new, front)]
                front = front[~dominated(front, new)]
            front = new if front is None else np.concatenate([front, new])
        if front is not None:
            yield pd.DataFrame(front, columns=names)

    return points.mapInPandas(run, points.schema)


def front_of(points: DataFrame, block: int = 8192) -> DataFrame:
    """The front of distinct points, larger being better. Fronts of partitions, dealt anew, until one block holds what is
    left or it hardly shrinks; then each block is compared with each other one."""
    names, before, left = points.columns, None, local_fronts(points).persist()
    for turn in range(1, 100):
        n = left.count()
        if before is not None:
            before[0].unpersist()
        k = max(1, math.ceil(n / block))
        if k > 1 and before is not None and n > 0.8 * before[1]:
            break
        before = left, n
        left = local_fronts(left.repartition(k, F.xxhash64(*names, F.lit(turn))) if k > 1 else left.coalesce(1))
        if k == 1:
            return left
        left = left.persist()
    own, every = F.pmod(F.xxhash64(*names), F.lit(k)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a, b = left.select(*names, own.alias("_i"), every.alias("_j")), left.select(*names, every.alias("_i"), own.alias("_j"))
    lost = lambda a, b: a.loc[dominated(a[names].to_numpy(float), b[names].to_numpy(float)), names]
    gone = a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(lost, points.schema)
    return left.join(gone.distinct(), names, "left_anti")


def pareto_front(df: DataFrame, up: Sequence[str], down: Sequence[str], key: str) -> DataFrame:
    """Rows that no other row dominates, of a table of any size: null and NaN are the worst value; ties are all kept.
    Values are compared as doubles."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    own = df.where(F.coalesce(*map(number, [*up, *down])).isNotNull())
    own = own.withColumns({f"_{c}": F.coalesce((-1.0 if c in down else 1.0) * number(c), F.lit(float("-inf"))) + 0.0 for c in [*up, *down]})
    names = [f"_{c}" for c in [*up, *down]]
    return own.join(front_of(own.select(*names).distinct()), names, "left_semi").select(*df.columns)


def common_dates(df: DataFrame, key: str = "symbol", at: str = "dt") -> DataFrame:
    """Dates on which every symbol has a row: relational division by counts."""
    n = df.agg(F.countDistinct(key).alias("n_all"))
    return df.groupBy(at).agg(F.countDistinct(key).alias("n")).join(F.broadcast(n)).where("n = n_all").select(at)


def diffed(new: DataFrame, old: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """New against old by key: added, removed or both, and the change of each value."""
    a, b = new.select(key, *[F.col(v).alias(f"{v}_new") for v in values]), old.select(key, *[F.col(v).alias(f"{v}_old") for v in values])
    a, b = a.withColumn("_n", F.lit(True)), b.withColumn("_o", F.lit(True))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("both")
    return a.join(b, key, "full_outer").select(key, state.alias("state"), *[(F.col(f"{v}_new") - F.col(f"{v}_old")).alias(f"{v}_delta") for v in values])


def upserted(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing and incoming rows; of one key the incoming row wins as a whole."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(incoming.withColumn("_p", F.lit(1)))
    return latest(both, keys, [F.col("_p").desc()]).drop("_p")


def ingest_gaps(wanted: DataFrame, have: DataFrame, key: str = "symbol", chunk_days: int = 365) -> DataFrame:
    """Date ranges to fetch: before the first and after the last date at hand, in chunks. wanted (key, start, end), have
    (key, first_dt, last_dt)."""
    c = F.col
    gap = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    whole = F.array(gap(c("start"), c("end")))
    parts = F.array(gap(c("start"), F.least(c("end"), F.date_sub("first_dt", 1))), gap(F.greatest(c("start"), F.date_add("last_dt", 1)), c("end")))
    gaps = wanted.join(have, key, "left").select(key, F.explode(F.when(c("first_dt").isNull(), whole).otherwise(parts)).alias("g")).where("g.lo <= g.hi")
    starts = F.explode(F.sequence("g.lo", "g.hi", F.expr(f"INTERVAL {chunk_days} DAYS"))).alias("lo")
    return gaps.select(key, "g.hi", starts).select(key, "lo", F.least("hi", F.date_add("lo", chunk_days - 1)).alias("hi"))
