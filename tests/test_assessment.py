"""Ranks by ranges, corrections, caps, permutations and silences against plain versions, with ties, nulls and no rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import assessment, scoring, tables, universe
from spreadloom.streaming import jobs


@pytest.fixture(scope="module")
def values(spark):
    """3,000 rows with many ties, a third of them at one value, and some nulls."""
    rng = np.random.default_rng(7)
    v = np.where(rng.random(3000) < 0.35, 0.5, rng.integers(1, 900, 3000) / 1000)
    return spark.createDataFrame([(f"k{i:05d}", None if i % 97 == 0 else float(x)) for i, x in enumerate(v)], "key string, v double")


def test_ranks_equal_sorting(values):
    rows = values.toPandas()
    have = rows.dropna().sort_values(["v", "key"], ascending=[False, True]).reset_index(drop=True)
    want = {k: i + 1 for i, k in enumerate(have["key"])}
    got = tables.ranked(values, F.col("v"), "key").toPandas()
    assert len(got) == len(rows)
    assert {k: int(r) for k, r in zip(got["key"], got["rank"]) if not pd.isna(r)} == want


def test_corrected_p_equals_step_up(values):
    got = scoring.corrected_p(values, "v", "key").toPandas().dropna().sort_values(["p", "key"])
    p, n = got["p"].to_numpy(), len(got)
    bh = np.minimum(1, np.minimum.accumulate((p * n / np.arange(1, n + 1))[::-1])[::-1])
    np.testing.assert_allclose(got["bh"], bh, rtol=1e-12)
    np.testing.assert_allclose(got["bonferroni"], np.minimum(1, p * n), rtol=1e-12)


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "key string, v double")
    assert tables.ranked(none, F.col("v"), "key").count() == 0 and scoring.corrected_p(none, "v", "key").count() == 0


def test_mean_gaps_equal_all_pairs(values):
    rows = values.dropna().limit(200).toPandas()
    got = universe.mean_gaps(values.where(F.col("key").isin(list(rows["key"]))), "key", "v").toPandas().set_index("id")["mean_distance"]
    v = rows["v"].to_numpy()
    want = np.abs(v[:, None] - v).sum(1) / (len(v) - 1)
    np.testing.assert_allclose(got.loc[rows["key"]], want, rtol=1e-9)


def test_caps_hand_on_in_order(spark):
    w = spark.createDataFrame([("a", "x", 5.0), ("b", "x", 1.0), ("c", "y", 3.0), ("d", "z", 1.0), ("e", None, -2.0)], "symbol string, g string, weight double")
    got = {r.symbol: r.capped for r in assessment.capped_in_order(w, "g", {"x": 0.4, "y": 0.3, "absent": 0.1}).collect()}
    # x keeps 0.4 of 0.6; y gets 0.3 + 0.15 and keeps 0.3; its excess goes to x and z by their shares of 0.4 and 0.15
    x, z = 0.4 + 0.15 * 0.4 / 0.55, 0.15 + 0.15 * 0.15 / 0.55
    assert got == pytest.approx({"a": x * 5 / 6, "b": x / 6, "c": 0.3, "d": z, "e": 0.0})
    assert assessment.capped_in_order(w.limit(0), "g", {"x": 0.4}).count() == 0


def test_permutation_tells_momentum_from_noise(spark):
    rng = np.random.default_rng(3)
    noise, trend = rng.normal(size=400), np.repeat(rng.choice([-1.0, 1.0], 40), 10) + rng.normal(0, 0.3, 400)
    # blocks of 3 cut the runs of 10, so their order matters
    rows = [(k, pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), float(x)) for k, v in (("noise", noise), ("trend", trend), ("one", [0.1])) for i, x in enumerate(v)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "dt", "r"]))
    got = {r.symbol: r for r in assessment.block_permutation(df, "r", "symbol", 100, 3).collect()}
    assert got["trend"].observed == pytest.approx(np.mean(np.sign(trend[:-1]) * trend[1:])) and got["noise"].observed == pytest.approx(np.mean(np.sign(noise[:-1]) * noise[1:]))
    assert got["trend"].p == 0.01 and got["noise"].p > 0.01
    assert got["one"].observed is None


def test_sharpe_significance_of_no_ratio(spark):
    rows = spark.createDataFrame([(3, 1.0, 0.0, 0.0), (500, None, 0.0, 0.0), (500, 0.0, 0.0, 0.0), (500, 0.2, 0.0, 0.0)], "n int, sr double, skew double, kurt double")
    got = assessment.sharpe_significance(rows, 5).collect()
    assert [r.p for r in got[:2]] == [1.0, 1.0] and [r.is_long_enough for r in got] == [False, False, False, True]
    assert got[2].least_n == float("inf") and got[3].p < 1e-4


def test_rolling_map_of_short_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 4.0), ("a", 3, 2.0), ("b", 1, 5.0)], "symbol string, dt int, v double")
    got = {(r.symbol, r.dt): r.result for r in assessment.rolling_map(df, "symbol", "v", 2, lambda m: m.max(1)).collect()}
    assert got == {("a", 1): None, ("a", 2): 4.0, ("a", 3): 4.0, ("b", 1): None}


def test_silences(spark, tmp_path):
    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    batches = [[("a", 0), ("b", 0), ("a", 20)], [("a", 150), ("b", 30)], [("a", 5000)], [("a", 5010)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(pd.DataFrame([(c, at(s)) for c, s in b], columns=["component", "ts"])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("component string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.silences(stream, 60, 1000, "10 seconds").writeStream.format("memory").queryName("silences").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.component, r.from_ts.minute * 60 + r.from_ts.second, None if r.to_ts is None else (r.to_ts - pd.Timestamp("2024-01-01")).total_seconds(), r.level) for r in spark.table("silences").collect()}
    assert ("a", 20, 150.0, "WARN") in got and ("a", 150, 5000.0, "CRITICAL") in got
    assert ("b", 30, None, "WARN") in got and ("b", 30, None, "CRITICAL") in got and len(got) == 4
