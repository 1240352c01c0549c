"""Corrections touch only the folders of their keys; batches are applied once; versions stay readable until swept."""

import os

import pytest
from pyspark.sql import functions as F

from spreadloom.sources.versioned import VersionedTable, corrected

SCHEMA = "k string, n int, v double"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path / "data") for f in fs if f.endswith(".parquet")}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], "n", buckets=16)
    assert t.apply(spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("n"), F.col("id").cast("double").alias("v")), 0)
    before, first = files(tmp_path / "t"), t.manifest()
    assert len(first["folders"]) == 16
    assert t.apply(rows(spark, ("k3", 2, -3.0), ("new", 1, 9.0)), 1)
    after, second = files(tmp_path / "t"), t.manifest()
    changed = [b for b in second["folders"] if second["folders"][b] != first["folders"][b]]
    assert len(changed) <= 2 and before.items() <= after.items()  # no file was written again
    got = {r.k: (r.n, r.v) for r in t.read().collect()}
    assert len(got) == 401 and got["k3"] == (2, -3.0) and got["k4"] == (1, 4.0) and got["new"] == (1, 9.0)
    assert {r.k: r.v for r in t.read(1).collect()}["k3"] == 3.0


def test_batches_are_applied_once_and_the_later_row_wins(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], "n", buckets=3)
    with pytest.raises(ValueError):
        t.read()
    first = rows(spark, ("a", 1, 1.0), ("a", 3, 3.0), ("b", None, 5.0), (None, 1, 7.0), ("a", 3, 2.0))
    assert t.apply(first, 0) and not t.apply(first, 0)
    assert content(t.read()) == content(rows(spark, ("a", 3, 3.0), ("b", None, 5.0), (None, 1, 7.0)))
    assert t.apply(rows(spark, ("a", 2, 9.0), ("b", None, 6.0), (None, 1, 8.0)), 5)  # an older row of a, equal ones of the others
    assert content(t.read()) == content(rows(spark, ("a", 3, 3.0), ("b", None, 6.0), (None, 1, 8.0)))
    assert not t.apply(rows(spark, ("z", 9, 9.0)), 4) and t.versions() == [1, 2]
    assert t.apply(spark.createDataFrame([], SCHEMA), 6) and content(t.read()) == content(t.read(2))


def test_a_failed_attempt_is_not_seen_and_swept(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], "n", buckets=2)
    t.apply(rows(spark, ("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)), 0)
    commit, t.commit = t.commit, lambda m: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        t.apply(rows(spark, ("a", 2, 2.0)), 1)
    assert content(t.read()) == content(rows(spark, ("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)))
    t.commit = commit
    assert t.apply(rows(spark, ("a", 2, 2.0)), 1)
    with pytest.raises(RuntimeError, match="another"):
        t.commit(t.manifest())
    was = content(t.read())
    assert t.sweep() >= 2 and content(t.read()) == was and t.versions() == [2]
    with pytest.raises(ValueError):
        t.read(1)


def test_a_stream_of_corrections_goes_on_where_it_ended(spark, tmp_path):
    for r in (("a", 1, 1.0), ("b", 1, 2.0)), (("a", 2, 9.0),):
        rows(spark, *r).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        corrected(stream, VersionedTable(spark, str(tmp_path / "t"), ["k"], "n"), str(tmp_path / "cp")).awaitTermination()
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], "n")
    assert t.versions() == [1, 2] and content(t.read()) == content(rows(spark, ("a", 2, 9.0), ("b", 1, 2.0)))
