"""A stream run to its end over files equals its batch twin on the same rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import sequential
from spreadloom.sources import panels
from spreadloom.streaming import jobs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def ticks(spark, tmp_path):
    """The ticks in files in order of time, and as a stream of one file a batch."""
    rows = panels.ticks(spark, SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = rows.toPandas().sort_values("ts")
    for k in range(4):
        spark.createDataFrame(batch.iloc[k * len(batch) // 4 : (k + 1) * len(batch) // 4], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, mode="complete"):
    name = f"t{id(stream)}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def same(a, b):
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


def test_bars_surveillance_and_sessions(ticks):
    batch, stream = ticks
    same(run(jobs.tick_bars(stream, "1 hour")), jobs.tick_bars(batch, "1 hour"))
    same(run(jobs.breach_share(stream, 90.0, "6 hours", "2 hours")), jobs.breach_share(batch, 90.0, "6 hours", "2 hours"))
    same(run(jobs.activity_sessions(stream, "30 minutes")), jobs.activity_sessions(batch, "30 minutes"))


def test_suppression(spark, tmp_path):
    at = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01 00:02:00", "2024-01-01 00:05:00"])
    spark.createDataFrame(pd.DataFrame({"source": "s", "rule": "r", "ts": at})).write.parquet(str(tmp_path / "a"))
    schema = "source string, rule string, ts timestamp"
    out = run(jobs.suppressed_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "a")), 60, 2), "append").orderBy("ts").collect()
    assert [(r.ts.minute, r.flapping) for r in out] == [(0, False), (2, True), (5, False)]
    assert run(jobs.first_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "a")), ["source", "rule"], "1 hour"), "append").count() == 1


def test_episodes_equal_their_batch_twin(spark, tmp_path):
    z = [0, 2.5, 1.0, 0.2, -2.2, -3.0, -4.5, 2.1] + [1.5] * 6 + [0]
    days = pd.date_range("2024-01-01", periods=len(z))
    rows = spark.createDataFrame(pd.DataFrame({"pair_id": "p", "ts": days, "z": [float(v) for v in z]}))
    rows.write.parquet(str(tmp_path / "z"))
    live = run(jobs.episodes(spark.readStream.schema("pair_id string, ts timestamp, z double").parquet(str(tmp_path / "z")), 2.0, 0.5, 4.0, 5), "append")
    batch = sequential.trade_episodes(rows.select("pair_id", F.to_date("ts").alias("dt"), "z"), 2.0, 0.5, 4.0, 5)
    as_rows = lambda d, c: [(str(r[c])[:10], r.event, r.direction, round(r.pnl_z, 9)) for r in d.orderBy(c).collect()]
    assert as_rows(live, "ts") == as_rows(batch, "dt")
    assert [e for _, e, _, _ in as_rows(batch, "dt")] == ["OPEN", "EXIT", "OPEN", "STOP", "OPEN", "TIME"]


def test_corrections_are_idempotent(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, n int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 2, 9.0)], "k string, n int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("k string, n int, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.corrected(spark, stream, str(tmp_path / "out"), ["k"], str(tmp_path / "cp")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out" / "v=1"))
    assert {r.k for r in last.collect()} == {"a", "b"} and last.count() == 2
