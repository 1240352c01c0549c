"""Streaming jobs; each works on a batch DataFrame too, so that the same rows give the same result either way."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def marked(df: DataFrame, at: str = "ts", late: str = LATE) -> DataFrame:
    """With a watermark if it is a stream."""
    return df.withWatermark(at, late) if df.isStreaming else df


def tick_bars(ticks: DataFrame, width: str, late: str = LATE) -> DataFrame:
    """OHLC bars per symbol and tumbling window; late ticks beyond the watermark are left out."""
    at = F.struct("ts", "event_id")
    g = marked(ticks, late=late).groupBy(F.window("ts", width).alias("w"), "symbol").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n"))
    return g.select("symbol", F.col("w.start").alias("start_ts"), "open", "high", "low", "close", "n")


def breach_share(ticks: DataFrame, threshold: float, width: str, slide: str, late: str = LATE) -> DataFrame:
    """Share of values above a threshold per kind in sliding windows."""
    g = marked(ticks, late=late).groupBy(F.window("ts", width, slide).alias("w"), "kind").agg(F.count("*").alias("n"), F.avg((F.col("price") > threshold).cast("double")).alias("breach_share"))
    return g.select("kind", F.col("w.start").alias("start_ts"), "n", "breach_share")


def activity_sessions(ticks: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    g = marked(ticks, late=late).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count("*").alias("n"))
    return g.select("symbol", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def first_alerts(alerts: DataFrame, keys: list[str], window: str) -> DataFrame:
    """Drops repeats of an alert within the watermark."""
    return alerts.withWatermark("ts", window).dropDuplicatesWithinWatermark(keys)


def suppressed_alerts(alerts: DataFrame, seconds: int, flap_count: int) -> DataFrame:
    """Per (source, rule): the first alert passes; repeats within the window of the last passed one don't; from
    ``flap_count`` repeats on the next one that passes is marked as flapping. State: the last passed time and the count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, repeats = state.get if state.exists else (None, 0)
        out = []
        for ts in sorted(t for b in batches for t in b["ts"]):
            if last is None or (ts - pd.Timestamp(last, unit="us")).total_seconds() >= seconds:
                out.append((*key, ts, repeats >= flap_count))
                last, repeats = ts.value // 1000, 0
            else:
                repeats += 1
        state.update((last, repeats))
        yield pd.DataFrame(out, columns=["source", "rule", "ts", "flapping"])

    return alerts.select("source", "rule", "ts").groupBy("source", "rule").applyInPandasWithState(step, "source string, rule string, ts timestamp, flapping boolean", "last long, repeats int", "append", GroupStateTimeout.NoTimeout)


def silences(beats: DataFrame, seconds: int, critical: int, late: str = LATE) -> DataFrame:
    """Per component of a stream (component, ts): every silence longer than the threshold once it has ended; of a component
    that is silent still, WARN once the watermark is ``seconds`` past its last beat and CRITICAL once it is ``critical``
    past it. State: the last beat and the alarms given; a critical component leaves the state, so that state doesn't grow
    with components that are gone."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, (last, level) = [], state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            out.append((*key, pd.Timestamp(last, unit="us"), None, "CRITICAL" if level else "WARN"))
            level += 1
        for ts in sorted(t for b in batches for t in b["ts"]) if not state.hasTimedOut else []:
            at = ts.value // 1000
            gap = 0.0 if last is None else (at - last) / 1e6
            if gap > seconds:
                out.append((*key, pd.Timestamp(last, unit="us"), ts, "CRITICAL" if gap > critical else "WARN"))
            if last is None or at > last:
                last, level = at, 0
        if level > 1:
            state.remove()
        else:
            state.update((last, level))
            state.setTimeoutTimestamp(max(last // 1000 + 1000 * (critical if level else seconds), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["component", "from_ts", "to_ts", "level"])

    timed = beats.select("component", "ts").withWatermark("ts", late)
    schema = "component string, from_ts timestamp, to_ts timestamp, level string"
    return timed.groupBy("component").applyInPandasWithState(step, schema, "last long, level int", "append", GroupStateTimeout.EventTimeTimeout)


def episodes(zs: DataFrame, entry: float, exit_: float, stop: float, max_hold: int) -> DataFrame:
    """Per pair: transitions of FLAT and OPEN over a live z. Opens at |z| >= entry, closes inside exit, beyond stop, or
    after max_hold rows. State: direction, rows held, entry z."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        direction, held, entry_z = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out, (direction, held, entry_z) = walk(rows, direction, held, entry_z, entry, exit_, stop, max_hold)
        state.update((direction, held, entry_z))
        yield pd.DataFrame([(*key, *x) for x in out], columns=["pair_id", "ts", "event", "direction", "pnl_z"])

    return zs.groupBy("pair_id").applyInPandasWithState(step, "pair_id string, ts timestamp, event string, direction int, pnl_z double", "direction int, held int, entry_z double", "append", GroupStateTimeout.NoTimeout)


def walk(rows: pd.DataFrame, direction: int, held: int, entry_z: float, entry: float, exit_: float, stop: float, max_hold: int) -> tuple[list, tuple]:
    """The transitions of one pair's ordered rows (ts, z), from a state."""
    out = []
    for ts, z in zip(rows["ts"], rows["z"]):
        if pd.isna(z):
            continue
        if direction == 0:
            if abs(z) >= entry and abs(z) < stop:
                direction, held, entry_z = (-1 if z > 0 else 1), 0, float(z)
                out.append((ts, "OPEN", direction, 0.0))
            continue
        held += 1
        why = "STOP" if abs(z) >= stop else "EXIT" if abs(z) <= exit_ else "TIME" if held >= max_hold else None
        if why:
            out.append((ts, why, direction, direction * (float(z) - entry_z)))
            direction, held, entry_z = 0, 0, 0.0
    return out, (direction, held, entry_z)


def corrected(spark, stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Upserts each micro-batch into a Parquet table: of a key the later row wins. Writing a batch again changes nothing."""
    from spreadloom.operators.tables import upserted

    def put(batch: DataFrame, number: int) -> None:
        target = f"{path}/v={number}"
        before = spark.read.parquet(f"{path}/v={number - 1}") if number else batch.limit(0)  # a missing version fails
        upserted(before, batch, keys).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
