"""Queries of the streams with timers: their machines run over the given tables as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.plans.job_queries import SPZ, spread_z
from spreadloom.plans.registry import register
from spreadloom.sources import panels
from spreadloom.sources.shared import fresh_path
from spreadloom.sources.versioned import VersionedTable
from spreadloom.streaming import stateful as st

DAY = 86_400
END = "2024-02-10 00:00:00"


def timed(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df, *columns):
    """Moments as the tables have them, without a zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", *columns)})


@register(f""", b AS (SELECT symbol, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS next FROM ticks),
d AS (SELECT *, coalesce(next, epoch_us(TIMESTAMP '{END}') + 1) - us AS gap FROM b)
SELECT symbol, make_timestamp(us + {DAY} * 1000000::BIGINT) AS ts, 'WARN' AS event, make_timestamp(us) AS from_ts, {DAY}::DOUBLE AS seconds FROM d WHERE gap > {DAY} * 1000000::BIGINT
UNION ALL SELECT symbol, make_timestamp(us + {3 * DAY} * 1000000::BIGINT), 'CRITICAL', make_timestamp(us), {3 * DAY}::DOUBLE FROM d WHERE gap > {3 * DAY} * 1000000::BIGINT
UNION ALL SELECT symbol, make_timestamp(next), CASE WHEN gap > {3 * DAY} * 1000000::BIGINT THEN 'ENDED_CRITICAL' ELSE 'ENDED_WARN' END, make_timestamp(us), round(gap / 1e6, 3) FROM d
  WHERE next IS NOT NULL AND gap > {DAY} * 1000000::BIGINT AND gap <= {6 * DAY} * 1000000::BIGINT""")
def n02_silences(spark, d):
    """Open and ended silences of every symbol's ticks."""
    found = st.replayed(timed(panels.ticks(spark, d)).select("symbol", "ts"), ["symbol"], st.Silence(DAY, 3 * DAY, 6 * DAY), END)
    return plain(found, "from_ts").withColumn("seconds", F.round("seconds", 3))


@register(f""", t AS MATERIALIZED (SELECT kind, epoch_us(ts) AS us, row_number() OVER (PARTITION BY kind ORDER BY ts) AS k, count(*) OVER (PARTITION BY kind) AS n FROM ticks WHERE price > 90),
s AS (SELECT kind, us, k, n, us AS passed, 0::BIGINT AS repeats, true AS fired, 0::BIGINT AS before, NULL::BIGINT AS quiet_at, 0::BIGINT AS quiet FROM t WHERE k = 1 UNION ALL
  SELECT kind, us, k, n, CASE WHEN gone OR us - passed >= 3600000000 THEN us ELSE passed END, CASE WHEN gone OR us - passed >= 3600000000 THEN 0 ELSE repeats + 1 END,
    gone OR us - passed >= 3600000000, CASE WHEN gone THEN 0 ELSE repeats END, CASE WHEN gone AND repeats > 0 THEN last + 14400000000 END, CASE WHEN gone THEN repeats ELSE 0 END
  FROM (SELECT t.kind, t.us, t.k, t.n, s.passed, s.repeats, s.us AS last, t.us - s.us > 14400000000 AS gone FROM s JOIN t ON t.kind = s.kind AND t.k = s.k + 1))
SELECT kind, make_timestamp(us) AS ts, 'FIRED' AS event, before::INT AS repeats, before >= 3 AS flapping FROM s WHERE fired
UNION ALL SELECT kind, make_timestamp(quiet_at), 'QUIET', quiet::INT, quiet >= 3 FROM s WHERE quiet_at IS NOT NULL
UNION ALL SELECT kind, make_timestamp(us + 14400000000), 'QUIET', repeats::INT, repeats >= 3 FROM s WHERE k = n AND repeats > 0 AND us + 14400000000 <= epoch_us(TIMESTAMP '{END}')""", recursive=True)
def n03_suppressed_alerts(spark, d):
    """Alerts of each kind of tick over 90: at most one an hour passes, a kind that is quiet for four hours is forgotten."""
    alerts = timed(panels.ticks(spark, d).where("price > 90")).select("kind", "ts")
    return plain(st.replayed(alerts, ["kind"], st.Suppression(3600, 3, 4 * 3600), END))


@register(f"""{SPZ}, t AS MATERIALIZED (SELECT pair_id, epoch_us(dt::TIMESTAMP) AS us, z, row_number() OVER (PARTITION BY pair_id ORDER BY dt) AS k, count(*) OVER (PARTITION BY pair_id) AS n FROM zs WHERE z IS NOT NULL),
u AS (SELECT pair_id, us, z, k, n FROM t UNION ALL SELECT pair_id, epoch_us(TIMESTAMP '2002-06-01'), NULL, n + 1, n FROM t WHERE k = n),
s AS (SELECT pair_id, 0::BIGINT AS k, NULL::INT AS phase, 0 AS dir, 0.0::DOUBLE AS ez, 0.0::DOUBLE AS lz, 0::BIGINT AS since, NULL::BIGINT AS t1, NULL::DOUBLE AS p1, NULL::BIGINT AS t2, NULL::BIGINT AS t3, NULL::VARCHAR AS e3, NULL::DOUBLE AS p3, 0 AS d1, 0 AS d3
    FROM (SELECT DISTINCT pair_id FROM t) UNION ALL
  SELECT pair_id, k, CASE WHEN opens THEN 0 WHEN closes THEN 1 ELSE phase END, CASE WHEN opens THEN -sign(z)::INT ELSE dir END, CASE WHEN opens THEN z ELSE ez END, CASE WHEN phase = 0 OR opens THEN coalesce(z, lz) ELSE lz END,
    CASE WHEN opens OR closes THEN us ELSE since END, t1, p1, t2, CASE WHEN opens OR closes THEN us END, CASE WHEN opens THEN 'OPEN' WHEN closes AND abs(z) >= 3 THEN 'STOP' WHEN closes THEN 'EXIT' END,
    CASE WHEN opens THEN 0 WHEN closes THEN dir * (z - ez) END, d1, CASE WHEN opens THEN -sign(z)::INT ELSE dir END
  FROM (SELECT *, phase IS NULL AND abs(z) >= 1.5 AND abs(z) < 3 AS opens, coalesce(phase = 0 AND (abs(z) >= 3 OR abs(z) <= 0.5), false) AS closes
    FROM (SELECT pair_id, k, us, z, CASE WHEN t2 IS NOT NULL THEN NULL ELSE phase END AS phase, dir, ez, lz, since, t1, p1, t2, dir AS d1
      FROM (SELECT *, CASE WHEN phase = 1 AND since + 5184000000000 < us + last THEN since + 5184000000000 END AS t2
        FROM (SELECT pair_id, k, us, z, dir, ez, lz, last, CASE WHEN timed THEN 1 ELSE phase END AS phase, CASE WHEN timed THEN since + 10368000000000 ELSE since END AS since, CASE WHEN timed THEN since + 10368000000000 END AS t1, CASE WHEN timed THEN dir * (lz - ez) END AS p1
          FROM (SELECT u.pair_id, u.k, u.us, u.z, s.phase, s.dir, s.ez, s.lz, s.since, (u.k > u.n)::BIGINT AS last, coalesce(s.phase = 0 AND s.since + 10368000000000 < u.us + (u.k > u.n)::BIGINT, false) AS timed FROM s JOIN u ON u.pair_id = s.pair_id AND u.k = s.k + 1))))))
SELECT pair_id, make_timestamp(t1) AS ts, 'TIME' AS event, d1 AS direction, round(p1, 5) + 0.0 AS pnl_z FROM s WHERE t1 IS NOT NULL
UNION ALL SELECT pair_id, make_timestamp(t2), 'READY', d1, NULL FROM s WHERE t2 IS NOT NULL
UNION ALL SELECT pair_id, make_timestamp(t3), e3, d3, round(p3, 5) + 0.0 FROM s WHERE t3 IS NOT NULL""", "month", recursive=True)
def n05_episodes(spark, d):
    """Episodes of the spread z of every pair, held for 120 days at most, with 60 days of rest."""
    zs = spread_z(spark, d).select("pair_id", F.col("dt").cast("timestamp").alias("ts"), "z")
    found = st.replayed(zs, ["pair_id"], st.Episode(1.5, 0.5, 3.0, 120 * DAY, 60 * DAY), "2002-06-01 00:00:00", "z")
    return plain(found).withColumn("pnl_z", F.round("pnl_z", 5) + 0.0)


@register("""SELECT o_orderkey AS k, CASE WHEN l.v IS NOT NULL THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END::INT AS n, round(CASE WHEN l.v IS NOT NULL THEN l.v WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END, 2) + 0.0 AS v
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey""")
def n07_corrections(spark, d):
    """Prices of orders under three batches of corrections, of which two come again and one brings older rows."""
    orders = panels.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("n"), F.col("o_totalprice").cast("double").alias("v"), "o_orderstatus")
    returned = panels.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.lit(2).alias("n"), F.sum("l_extendedprice").cast("double").alias("v"))
    opened = orders.where("o_orderstatus = 'O'").select("k", F.lit(1).alias("n"), F.lit(0.0).alias("v"))
    table = VersionedTable(spark, fresh_path(spark, "corrections"), ["k"], "n", buckets=8)
    for number, batch in enumerate((orders.drop("o_orderstatus"), returned, opened, opened, returned)):
        table.apply(batch, min(number, 2))
    return table.read().withColumn("v", F.round("v", 2) + 0.0)
