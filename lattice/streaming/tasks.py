"""Streams of task events: windows, dedup, state checks, throttling, limits and expiry.

Every function takes a streaming (or batch) DataFrame and returns one; watermarks need a TIMESTAMP, so a
TIMESTAMP_NTZ column is cast first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattice.operators import folds


def with_event_time(events: DataFrame, column: str, lateness: str) -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, lateness: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped by Spark."""
    g = with_event_time(events, time, lateness).groupBy(F.window(time, width).alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, time: str, width: str, step: str, value: str, lateness: str = "1 hour") -> DataFrame:
    g = with_event_time(events, time, lateness).groupBy(F.window(time, width, step).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean")).select(F.col("w.start").alias("window_start"), "n", "mean")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    g = with_event_time(events, time, lateness).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_each(events: DataFrame, time: str, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Each key once while its state is inside the watermark."""
    return with_event_time(events, time, lateness).dropDuplicatesWithinWatermark(keys)


def late_rows(events: DataFrame, time: str, watermark: str) -> DataFrame:
    """Split-off for what a watermark at a fixed time would drop, so that late rows can be counted."""
    return events.where(F.col(time).cast("timestamp") < F.lit(watermark).cast("timestamp"))


def _per_key(events: DataFrame, key: str, advance, output: str, state: str) -> DataFrame:
    return events.groupBy(key).applyInPandasWithState(advance, output, state, "append", GroupStateTimeout.NoTimeout)


def _sorted(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["t", "event_id"], kind="stable")


def state_changes(events: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, event_id, status, legal): whether each status may follow the one before it. Input: key, event_id, t, status."""

    def advance(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = _sorted(frames)
        legal = []
        for status in rows.status:
            ok = folds.legal(before, status)
            legal.append(ok)
            before = status if ok else before
        if before is not None:
            state.update((before,))
        yield pd.DataFrame({key: k[0], "event_id": rows.event_id, "status": rows.status, "legal": legal})

    kind = events.schema[key].dataType.simpleString()
    return _per_key(events, key, advance, f"{key} {kind}, event_id long, status string, legal boolean", "status string")


def throttled(events: DataFrame, key: str = "task_id", step: float = 5, interval: float = 2, terminal: tuple[str, ...] = folds.FINAL) -> DataFrame:
    """(key, event_id): updates that are written. Input: key, event_id, t (seconds), status, progress."""

    def advance(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(frames)
        times, status, progress = rows.t.tolist(), rows.status.tolist(), rows.progress.tolist()
        if state.exists:  # the last written update stands before the new ones
            t, s, p = state.get
            times, status, progress = [t, *times], [s, *status], [p, *progress]
        written = folds.throttle(times, status, progress, terminal, step, interval)
        last = max((i for i, w in enumerate(written) if w), default=None)
        if last is not None:
            state.update((float(times[last]), status[last], float(progress[last])))
        new = written[len(times) - len(rows) :]
        yield pd.DataFrame({key: k[0], "event_id": rows.event_id[new]})

    kind = events.schema[key].dataType.simpleString()
    return _per_key(events, key, advance, f"{key} {kind}, event_id long", "t double, status string, progress double")


def rate_limited(events: DataFrame, per_minute: float, burst: float, key: str = "user_id") -> DataFrame:
    """(key, event_id, allowed) by a token bucket for each key. Input: key, event_id, t (seconds)."""

    def advance(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(frames)
        held, allowed = state.get if state.exists else None, []
        for t in rows.t:
            held, passes = folds.bucket_step(held, float(t), per_minute, burst)
            allowed.append(bool(passes))
        state.update((float(held[0]), held[1]))
        yield pd.DataFrame({key: k[0], "event_id": rows.event_id, "allowed": allowed})

    kind = events.schema[key].dataType.simpleString()
    return _per_key(events, key, advance, f"{key} {kind}, event_id long, allowed boolean", "tokens double, last double")


def breaker(events: DataFrame, threshold: int = 3, recovery: float = 30.0, key: str = "user_id") -> DataFrame:
    """(key, event_id, state) of a circuit breaker for each key. Input: key, event_id, t (seconds), ok and, if failures may not count, counted."""

    def advance(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(frames)
        held, out = state.get if state.exists else None, []
        counted = rows.counted if "counted" in rows else [True] * len(rows)
        for t, good, counts in zip(rows.t, rows.ok, counted, strict=True):
            held, answer = folds.circuit_step(held, float(t), bool(good), bool(counts), threshold, recovery)
            out.append(answer)
        state.update((int(held[0]), float(held[1])))
        yield pd.DataFrame({key: k[0], "event_id": rows.event_id, "state": out})

    kind = events.schema[key].dataType.simpleString()
    return _per_key(events, key, advance, f"{key} {kind}, event_id long, state string", "failures int, opened double")


def expired(tasks: DataFrame, now: str, keep: str, running: str) -> tuple[DataFrame, DataFrame]:
    """Finished tasks older than ``keep`` (they go), and unfinished ones older than ``running`` (they fail)."""
    age = lambda span: F.col("updated_at").cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {span}")
    done = F.col("status").isin("succeeded", "completed", "failed")
    return tasks.where(done & age(keep)), tasks.where(~done & age(running)).withColumn("status", F.lit("failed"))


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and return the result as a table in memory (for tests and small sinks)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
