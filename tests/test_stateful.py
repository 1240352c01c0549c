"""Streams with timers against their batch twins, and machines against plain walks, with late rows in append mode."""

import os
import random
import time

import pandas as pd
import pytest

from spreadloom.streaming import stateful as st

DAY = pd.Timestamp("2024-01-01")
SCHEMA = "k string, ts timestamp, z double"


def at(s):
    return DAY + pd.Timedelta(seconds=s)


def run(spark, tmp_path, batches, keys, machine, late, value=None):
    """One file a batch; a last row of another key, far ahead, moves the watermark past everything."""
    for n, rows in enumerate(batches):
        frame = pd.DataFrame([(k, at(s), z) for k, s, z in rows], columns=["k", "ts", "z"])
        spark.createDataFrame(frame, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        for f in (tmp_path / f"in/{n}").glob("*.parquet"):
            f.rename(tmp_path / f"in/{n:03d}.parquet")
        os.utime(tmp_path / f"in/{n:03d}.parquet", (time.time() + n, time.time() + n))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*.parquet"))
    name = f"s{abs(hash(str(tmp_path)))}"
    q = st.live(stream, keys, machine, late, value).writeStream.format("memory").queryName(name).outputMode("append")
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.where("k <> 'end'").collect())))


MACHINES = {
    "silence": (st.Silence(60, 300, 3000), None),
    "suppression": (st.Suppression(60, 2, 600), None),
    "episode": (st.Episode(2.0, 0.5, 4.0, 300, 120), "z"),
}


@pytest.mark.parametrize("name", MACHINES)
def test_streams_equal_their_twins_with_late_rows(spark, tmp_path, name):
    machine, value = MACHINES[name]
    rng = random.Random(name)
    rows = [(k, s, rng.choice([0.1, 1.0, 2.5, -2.5, 3.0, -4.5, None])) for k in "abc" for s in sorted(rng.sample(range(4000), 60))]
    rows += [("d", 100, 2.5), ("d", 100, 0.1), ("d", 130, None)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 25))  # arrive up to 25 seconds out of order
    batches = [rows[i::1][:45] for i in range(0, len(rows), 45)]
    too_late = ("a", 1, 3.9)
    batches = [*batches, [too_late], [("end", 40_000, 0.0)], [("end", 80_000, 0.0)]]
    got = run(spark, tmp_path, batches, ["k"], machine, "30 seconds", value)
    flat = pd.DataFrame([(k, at(s), z) for k, s, z in rows], columns=["k", "ts", "z"])  # without the row that is too late
    twin = st.replayed(spark.createDataFrame(flat, SCHEMA), ["k"], machine, str(at(40_000 - 30)), value)
    assert rows_of(got) == rows_of(twin) and got.count() > 10


def replay(machine, rows, until):
    return st.advanced(machine, None, [(s * st.SECOND, z) for s, z in rows], until * st.SECOND)


def test_a_silent_component_warns_then_is_critical_then_is_forgotten():
    m = st.Silence(60, 300, 1000)
    at_s = lambda events: [(e[0] / st.SECOND, e[1], e[3]) for e in events]
    state, events = replay(m, [(0, None), (60, None), (200, None)], 210)
    assert at_s(events) == [(120, "WARN", 60), (200, "ENDED_WARN", 140)] and state is not None
    state, events = replay(m, [(0, None)], 400)
    assert at_s(events) == [(60, "WARN", 60), (300, "CRITICAL", 300)] and state is not None
    state, events = replay(m, [(0, None), (500, None)], 500)
    assert at_s(events)[-1] == (500, "ENDED_CRITICAL", 500)
    assert replay(m, [(0, None)], 1000)[0] is None
    assert at_s(replay(m, [(0, None), (2000, None)], 2000)[1]) == [(60, "WARN", 60), (300, "CRITICAL", 300)]


def test_suppression_counts_and_forgets():
    events = replay(st.Suppression(60, 2, 100), [(0, None), (10, None), (20, None), (60, None), (70, None), (400, None)], 400)[1]
    assert [(e[0] / st.SECOND, *e[1:]) for e in events] == [(0, "FIRED", 0, False), (60, "FIRED", 2, True), (170, "QUIET", 1, False), (400, "FIRED", 0, False)]


def test_episode_holds_and_rests_by_time():
    m = st.Episode(2.0, 0.5, 4.0, 100, 50)
    events = replay(m, [(0, 2.5), (10, 1.0), (120, 3.0), (160, -2.0), (170, -0.5), (200, 2.0), (221, 5.0), (230, 2.0), (300, 1.0), (301, 4.5)], 1000)[1]
    assert [(e[0] / st.SECOND, *e[1:]) for e in events] == [
        (0, "OPEN", -1, 0.0), (100, "TIME", -1, 1.5), (150, "READY", -1, None), (160, "OPEN", 1, 0.0), (170, "EXIT", 1, 1.5), (220, "READY", 1, None),
        (230, "OPEN", -1, 0.0), (301, "STOP", -1, -2.5), (351, "READY", -1, None),
    ]


def test_batch_ends_at_the_latest_row_of_the_table(spark):
    rows = spark.createDataFrame([("a", at(0).to_pydatetime(), 1.0), ("b", at(500).to_pydatetime(), None), ("c", None, 1.0)], SCHEMA)
    got = st.replayed(rows, ["k"], st.Silence(60, 300, 1000)).orderBy("ts").collect()
    assert [(r.k, r.event, r.ts) for r in got] == [("a", "WARN", at(60)), ("a", "CRITICAL", at(300))]
    assert st.replayed(rows.limit(0), ["k"], st.Silence(60, 300, 1000)).count() == 0
