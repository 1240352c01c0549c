"""Streams that keep state a key, with timers and expiry, and the same results over a batch.

A machine says what a row and a deadline do to the state of a key. ``live`` runs it over a stream: rows wait in the state
until the watermark has passed them, so rows that arrive out of order within the allowed lateness are taken in order of
time, later ones are dropped by Spark; one timer a key wakes it for its next row or deadline. ``replayed`` runs the same
machine over a batch, in order of time up to a stated moment. Both give the same rows.

State holds the rows of the allowed lateness and one small tuple a key, and is removed when a machine ends it. Times
inside machines are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
State = tuple | None


class Machine:
    """What happens to a key: ``state`` is a DDL of the state's fields, ``out`` of the columns after the key and ``ts``."""

    state = ""
    out = ""

    def row(self, state: State, ts: int, value: Any) -> tuple[State, list[tuple]]:
        raise NotImplementedError

    def due(self, state: State) -> int | None:
        """When the state changes if no row comes before; rows of that very moment come first."""
        return None

    def expired(self, state: State, at: int) -> tuple[State, list[tuple]]:
        return None, []


class Silence(Machine):
    """A component that isn't heard of: WARN after ``seconds``, CRITICAL after ``critical``, with the silence still open, and a
    row when it ends. After ``forget`` seconds a component is taken for gone and leaves the state, its silence without an
    end. Rows: (ts, event, from_ts, seconds)."""

    state = "last long, level int"
    out = "event string, from_ts timestamp, seconds double"

    def __init__(self, seconds: float, critical: float, forget: float) -> None:
        self.after = [int(s * SECOND) for s in (seconds, critical, forget)]
        assert self.after == sorted(self.after), "thresholds are to rise"

    def row(self, state, ts, value):
        gap = 0 if state is None else ts - state[0]
        events = [(ts, "ENDED_CRITICAL" if gap > self.after[1] else "ENDED_WARN", state[0], gap / SECOND)] if gap > self.after[0] else []
        return (ts, 0), events

    def due(self, state):
        return state[0] + self.after[state[1]]

    def expired(self, state, at):
        last, level = state
        if level == 2:
            return None, []
        return (last, level + 1), [(at, ("WARN", "CRITICAL")[level], last, (at - last) / SECOND)]


class Suppression(Machine):
    """Alerts of a rule: the first passes, repeats within ``seconds`` of the last one that passed are counted and dropped. The
    next that passes after ``flaps`` repeats or more is flapping. A rule that stays quiet for ``forget`` seconds leaves the
    state, and if it had repeats, they are reported then. Rows: (ts, event, repeats, flapping)."""

    state = "passed long, last long, repeats int"
    out = "event string, repeats int, flapping boolean"

    def __init__(self, seconds: float, flaps: int, forget: float) -> None:
        self.window, self.flaps, self.forget = int(seconds * SECOND), flaps, int(forget * SECOND)
        assert self.forget >= self.window

    def row(self, state, ts, value):
        if state is not None and ts - state[0] < self.window:
            return (state[0], ts, state[2] + 1), []
        repeats = 0 if state is None else state[2]
        return (ts, ts, 0), [(ts, "FIRED", repeats, repeats >= self.flaps)]

    def due(self, state):
        return state[1] + self.forget

    def expired(self, state, at):
        return None, [(at, "QUIET", state[2], state[2] >= self.flaps)] if state[2] else []


class Episode(Machine):
    """A pair over a live z: FLAT, OPEN, COOLDOWN. Opens at |z| >= entry below stop, against the sign of z; closes inside
    ``exit_``, at stop, or by TIME ``max_hold`` seconds after it opened, whether rows come or not; then rests for
    ``cooldown`` seconds, and is READY. A flat pair has no state. Rows: (ts, event, direction, pnl_z)."""

    state = "phase int, direction int, entry_z double, last_z double, since long"
    out = "event string, direction int, pnl_z double"

    def __init__(self, entry: float, exit_: float, stop: float, max_hold: float, cooldown: float) -> None:
        self.entry, self.exit, self.stop = entry, exit_, stop
        self.hold, self.rest = int(max_hold * SECOND), int(cooldown * SECOND)

    def row(self, state, ts, value):
        if value is None or value != value:
            return state, []
        z = float(value)
        if state is None:
            if not self.entry <= abs(z) < self.stop:
                return None, []
            direction = -1 if z > 0 else 1
            return (0, direction, z, z, ts), [(ts, "OPEN", direction, 0.0)]
        phase, direction, entry_z, _, since = state
        if phase == 1:
            return state, []
        if abs(z) >= self.stop or abs(z) <= self.exit:
            return self.closed(state, ts, "STOP" if abs(z) >= self.stop else "EXIT", z)
        return (0, direction, entry_z, z, since), []

    def closed(self, state, ts, why, z):
        return (1, state[1], state[2], z, ts), [(ts, why, state[1], state[1] * (z - state[2]))]

    def due(self, state):
        return state[4] + (self.rest if state[0] else self.hold)

    def expired(self, state, at):
        return (None, [(at, "READY", state[1], None)]) if state[0] else self.closed(state, at, "TIME", state[3])


def advanced(machine: Machine, state: State, rows: list[tuple], until: int) -> tuple[State, list[tuple]]:
    """The state and events after the rows (ts, value), in order of time, and all deadlines up to a moment."""
    out, at = [], 0
    while True:
        due = None if state is None else machine.due(state)
        if at < len(rows) and (due is None or rows[at][0] <= due):
            state, events = machine.row(state, *rows[at])
            at += 1
        elif due is not None and due <= until:
            state, events = machine.expired(state, due)
        else:
            return state, out
        out += events


def as_frame(keys: list[str], key: tuple, machine: Machine, events: list[tuple]) -> pd.DataFrame:
    columns = [c.strip().split() for c in machine.out.split(",")]
    frame = pd.DataFrame([(*key, *e) for e in events], columns=[*keys, "ts", *[c for c, _ in columns]])
    for name in ["ts", *[c for c, kind in columns if kind == "timestamp"]]:
        frame[name] = pd.to_datetime(frame[name].astype("Int64"), unit="us", utc=True)
    return frame


def in_order(frame: pd.DataFrame) -> list[tuple]:
    """(ts, value) by time; rows of one moment by value, so that their order of arrival doesn't matter."""
    values = [None if pd.isna(v) else v for v in frame["value"]]
    return sorted(zip((int(t) for t in frame["at"]), values), key=lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0))


class Waiting(StatefulProcessor):
    """A machine over a stream: rows wait for the watermark, a timer wakes the key."""

    def __init__(self, machine: Machine, keys: list[str]) -> None:
        self.machine, self.keys = machine, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", self.machine.state)
        self.rows = handle.getListState("rows", "at long, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [r for frame in rows for r in in_order(frame)]
        self.rows.appendList(new)
        self.wake(min(t for t, _ in new), timerValues.getCurrentWatermarkInMs())
        yield as_frame(self.keys, key, self.machine, [])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(((int(r[0]), r[1]) for r in self.rows.get()), key=lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0))
        ready = [r for r in waiting if r[0] <= mark * 1000]
        later = waiting[len(ready) :]
        state = tuple(self.own.get()) if self.own.exists() else None
        state, events = advanced(self.machine, state, ready, mark * 1000)
        self.own.update(state) if state is not None else self.own.clear()
        self.rows.put(later) if later else self.rows.clear()
        due = [r[0] for r in later[:1]] + ([] if state is None else [self.machine.due(state)])
        if due:
            self.wake(min(due), mark)
        yield as_frame(self.keys, key, self.machine, events)

    def wake(self, at: int, mark: int) -> None:
        """Sets the timer for a moment, unless there is an earlier one; the only timer of a key is its next."""
        ms, before = max(-(-at // 1000), mark + 1), list(self.handle.listTimers())
        if before and min(before) <= ms and min(before) > mark:
            return
        for t in before:
            if t > mark:
                self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def prepared(df: DataFrame, keys: list[str], value: str | None) -> DataFrame:
    number = F.lit(None).cast("double") if value is None else F.col(value).cast("double")
    return df.where(F.col("ts").isNotNull()).select(*keys, "ts", F.unix_micros("ts").alias("at"), number.alias("value"))


def schema_of(df: DataFrame, keys: list[str], machine: Machine) -> str:
    return ", ".join([*[f"{k} {df.schema[k].dataType.simpleString()}" for k in keys], "ts timestamp", machine.out])


def live(stream: DataFrame, keys: list[str], machine: Machine, late: str, value: str | None = None) -> DataFrame:
    """The machine's rows over a stream (keys, ts, value), in append mode, each once the watermark has passed it. Needs the
    RocksDB state store, which is set for the session unless another store was chosen."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, "").rsplit(".", 1)[-1] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(name, ROCKSDB)
    rows = prepared(stream, keys, value).withWatermark("ts", late)
    return rows.groupBy(*keys).transformWithStateInPandas(Waiting(machine, keys), schema_of(stream, keys, machine), "Append", "EventTime")


def replayed(df: DataFrame, keys: list[str], machine: Machine, until: str | None = None, value: str | None = None) -> DataFrame:
    """The machine's rows over a batch, up to a moment, or up to the latest row of the table."""
    rows = prepared(df, keys, value)
    end = F.unix_micros(F.lit(until).cast("timestamp"))
    # The latest moment is one row.
    timed = rows.withColumn("_end", end) if until else rows.crossJoin(F.broadcast(rows.agg(F.max("at").alias("_end"))))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        last = int(frame["_end"].iloc[0])
        ready = [r for r in in_order(frame) if r[0] <= last]
        return as_frame(keys, key, machine, advanced(machine, None, ready, last)[1])

    return timed.groupBy(*keys).applyInPandas(run, schema_of(df, keys, machine))
