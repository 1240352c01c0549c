"""Data quality, freshness and operations checks: violations are rows, never exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import ordered, ratio, whole


def symbol_quality(df: DataFrame, key: str = "symbol", at: str = "dt", max_gap: int = 30, sigma: float = 4.0) -> DataFrame:
    """Rows, duplicates, nulls, zero volume, largest gap, jumps beyond sigma, warnings and status per series."""
    o = ordered(key, at)
    d = df.select(key, at, "close", "volume", F.datediff(at, F.lag(at).over(o)).alias("gap"), F.ln(ratio("close", F.lag("close").over(o))).alias("r"))
    d = d.withColumn("sd", F.stddev_samp("r").over(whole(key)))
    q = d.groupBy(key).agg(
        F.count("*").alias("n_rows"), F.countDistinct(at).alias("n_days"), F.avg(F.isnull("close").cast("double")).alias("null_share"), F.avg((F.col("volume") == 0).cast("double")).alias("zero_volume"), F.max("gap").alias("max_gap"),
        F.count_if((F.col("sd") > 0) & (F.abs("r") > sigma * F.col("sd"))).alias("n_jumps"),
    )
    rules = {"duplicates": F.col("n_rows") > F.col("n_days"), "nulls": F.col("null_share") > 0.05, "zero_volume": F.col("zero_volume") > 0.05, "gap": F.col("max_gap") > max_gap, "jumps": F.col("n_jumps") > 0}
    out = q.withColumn("warnings", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))
    return out.withColumn("status", F.when(F.size("warnings") == 0, "ok").when(F.size("warnings") <= 1, "warn").otherwise("bad"))


def bar_violations(df: DataFrame) -> DataFrame:
    """One row a broken rule of a bar."""
    rules = {"high_below_low": F.col("high") < F.col("low"), "close_outside": ~F.col("close").between(F.col("low"), F.col("high")), "not_positive": F.col("close") <= 0, "no_volume": F.coalesce("volume", F.lit(0.0)) <= 0}
    return df.select("symbol", "dt", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("violation"))


def weekend_grace(last: Column, now: Column) -> Column:
    """Friday's data is fresh until Monday 21:00."""
    return (F.dayofweek(last) == 6) & (F.datediff(now, last) <= 3) & ((F.dayofweek(now).isin(7, 1)) | ((F.dayofweek(now) == 2) & (F.hour(now) < 21)))


def freshness(df: DataFrame, now: str, max_hours: int, least: int, key: str = "symbol", at: str = "ts") -> DataFrame:
    """Rows, age, and the first reason not to use a series."""
    n = F.to_timestamp(F.lit(now))
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.max(at).alias("last_ts"))
    age = (F.unix_timestamp(n) - F.unix_timestamp("last_ts")) / 3600
    reason = F.when(F.col("n") < least, "SHORT").when((age > max_hours) & ~weekend_grace(F.col("last_ts"), n), "STALE").otherwise("OK")
    return g.select(key, "n", F.floor(age).alias("age_hours"), reason.alias("status"))


def order_reconciliation(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """(order_id, qty) against summed fills: duplicate ids, missing and partial fills, fills without order."""
    o = orders.groupBy("order_id").agg(F.count("*").alias("n_orders"), F.sum("qty").alias("ordered"))
    f = fills.groupBy("order_id").agg(F.sum("qty").alias("filled"))
    status = F.when(F.col("n_orders").isNull(), "no_order").when(F.col("n_orders") > 1, "duplicate").when(F.col("filled").isNull(), "missing_fill").when(F.abs(F.col("filled") - F.col("ordered")) > 0.1 * F.abs("ordered"), "partial").otherwise("ok")
    return o.join(f, "order_id", "full_outer").select("order_id", "ordered", "filled", status.alias("status"))


def repeated_actions(log: DataFrame, key: str, action: str, at: str, days: int, more_than: int) -> DataFrame:
    """Entities with more than so many of one action within the days up to it: a range frame on time."""
    w = Window.partitionBy(key, action).orderBy(F.unix_timestamp(at)).rangeBetween(-days * 86400, 0)
    c = log.withColumn("_n", F.count("*").over(w))
    return c.groupBy(key, action).agg(F.max("_n").alias("most")).where(F.col("most") > more_than)


def chain_breaks(log: DataFrame, chain: str, seq: str, this: str, previous: str) -> DataFrame:
    """Entries whose link isn't the entry before; the first break of each chain."""
    before = F.lag(this).over(Window.partitionBy(chain).orderBy(seq))
    return log.withColumn("_b", before).where(~F.col(previous).eqNullSafe(F.col("_b"))).groupBy(chain).agg(F.count("*").alias("n_breaks"), F.min(seq).alias("first_break"))


def deletable(records: DataFrame, holds: DataFrame, now: str) -> DataFrame:
    """Records past their date that no hold (entity, pattern) covers. Holds are few."""
    due = records.where((F.col("deletion_dt") <= F.lit(now).cast("date")) & (F.col("status") == "ACTIVE"))
    held = F.broadcast(holds.select(F.col("entity").alias("h_entity"), "pattern"))
    return due.join(held, (F.col("entity") == F.col("h_entity")) & F.expr("record_id LIKE pattern"), "left_anti")


def alert_groups(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("source", "rule").agg(F.count("*").alias("n"), F.max("severity").alias("severity"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def gaps(beats: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Silences longer than the threshold: the batch twin of the streaming heartbeat."""
    before = F.lag(at).over(ordered(key, at))
    s = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return beats.select(key, before.alias("from_ts"), F.col(at).alias("to_ts"), (s / 1e6).alias("seconds")).where(F.col("seconds") > seconds)


def sessions(events: DataFrame, key: str, at: str, minutes: int) -> DataFrame:
    """Activity grouped by inactivity: the batch form of a session window."""
    return events.groupBy(F.session_window(at, f"{minutes} minutes").alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")
