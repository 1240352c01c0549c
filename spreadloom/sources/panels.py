"""The given tables read as market data: bars, trades, ticks, macro series, trials. Plain DataFrames, nothing cached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """(symbol, dt, open, high, low, close, vwap, volume): unit prices of line items by brand and period.

    The part table is the small side; Spark decides by its size whether to broadcast it. Prices are aggregated map-side
    before the shuffle on (symbol, dt).
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("symbol", F.date_trunc(grain, "l_shipdate").cast("date").alias("dt"))
        .agg(
            F.min_by(px, at).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, at).alias("close"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"), F.sum("l_quantity").alias("volume"),
        )
    )


def segment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, dt, close, volume): mean order price by customer segment and day; few symbols, long series."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy("symbol", F.col("o_orderdate").cast("date").alias("dt")).agg(F.avg("o_totalprice").alias("close"), F.count("*").alias("volume"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector, n_parts, price): instrument metadata; the sector is the most common type, ties by name."""
    part = table(spark, sf_dir, "part")
    sector = part.groupBy("p_brand", "p_type").count().groupBy("p_brand").agg(F.min_by("p_type", F.struct(-F.col("count"), "p_type")).alias("sector"))
    return part.groupBy("p_brand").agg(F.count("*").alias("n_parts"), F.avg("p_retailprice").alias("price")).join(sector, "p_brand").select(F.col("p_brand").alias("symbol"), "sector", "n_parts", "price")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, discount, tax, returned, quantity): weekly factors."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("dt")).agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"), F.avg("l_quantity").alias("quantity")
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trade_id, pair, side, pnl, entry, exit_reason): orders as a trade log; pnl against a price of 250,000."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("pair"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("trade_id"), "pair", F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("side"), (F.col("o_totalprice") - 250000).alias("pnl"),
        F.col("o_orderdate").cast("date").alias("entry"), F.col("o_orderpriority").alias("exit_reason"), F.col("o_orderstatus").alias("status"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial_id, study_id, pair, score, sharpe, drawdown, state): parts as a table of search trials."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("trial_id"), F.col("p_size").alias("study_id"), F.col("p_brand").alias("pair"), F.col("p_retailprice").alias("score"),
        ((F.col("p_partkey") * 37 % 1000) / 250.0).alias("sharpe"), ((F.col("p_partkey") * 91 % 1000) / 1000.0).alias("drawdown"), F.when(F.col("p_type") == "PROMO", "PRUNED").otherwise("COMPLETE").alias("state"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, symbol, ts, price, kind)."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_type").alias("kind"), "props")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, leg_x, leg_y, notional_x, notional_y, strategy): open two-leg positions, one per supplier."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_name").alias("pair"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("leg_x"), F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("leg_y"),
        F.col("s_acctbal").alias("notional_x"), (-0.8 * F.col("s_acctbal")).alias("notional_y"), F.when(F.col("s_suppkey") % 3 == 0, "core").otherwise("satellite").alias("strategy"),
    )


#: The same panels for DuckDB.
SQL = """
bars AS (SELECT p_brand AS symbol, date_trunc('{grain}', l_shipdate)::DATE AS dt,
  first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close, sum(l_extendedprice) / sum(l_quantity) AS vwap, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
segs AS (SELECT c_mktsegment AS symbol, o_orderdate::DATE AS dt, avg(o_totalprice) AS close, count(*) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
meta AS (SELECT a.p_brand AS symbol, sector, n_parts, price FROM (SELECT p_brand, count(*) AS n_parts, avg(p_retailprice) AS price FROM part GROUP BY 1) a
  JOIN (SELECT p_brand, first(p_type ORDER BY n DESC, p_type) AS sector FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1) b ON a.p_brand = b.p_brand),
macro AS (SELECT date_trunc('week', l_shipdate)::DATE AS dt, avg(l_discount) AS discount, avg(l_tax) AS tax, avg((l_returnflag = 'R')::DOUBLE) AS returned, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1),
trades AS (SELECT o_orderkey AS trade_id, c_mktsegment AS pair, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, o_totalprice - 250000 AS pnl, o_orderdate::DATE AS entry,
  o_orderpriority AS exit_reason, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey),
trials AS (SELECT p_partkey AS trial_id, p_size AS study_id, p_brand AS pair, p_retailprice AS score, (p_partkey * 37 % 1000) / 250.0::DOUBLE AS sharpe, (p_partkey * 91 % 1000) / 1000.0::DOUBLE AS drawdown,
  CASE WHEN p_type = 'PROMO' THEN 'PRUNED' ELSE 'COMPLETE' END AS state FROM part),
ticks AS (SELECT event_id, user_id AS symbol, ts, value AS price, event_type AS kind, props FROM events),
positions AS (SELECT s_name AS pair, 'Brand#' || (s_suppkey % 25 + 1) AS leg_x, 'Brand#' || (s_nationkey + 1) AS leg_y, s_acctbal AS notional_x, -0.8 * s_acctbal AS notional_y,
  CASE WHEN s_suppkey % 3 = 0 THEN 'core' ELSE 'satellite' END AS strategy FROM supplier)
"""


def with_panels(sql: str, grain: str = "week", recursive: bool = False) -> str:
    """DuckDB SQL that may use the panels; ``sql`` begins with further CTEs after a comma, or with SELECT."""
    head = ("WITH RECURSIVE " if recursive else "WITH ") + SQL.format(grain=grain).strip()
    return head + (sql if sql.lstrip().startswith(",") else "\n" + sql)
