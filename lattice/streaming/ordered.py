"""Stateful streams whose results don't depend on how rows come in batches: rows wait for the watermark, timers end idle state.

The session needs the RocksDB state store (``STATE_STORE``), which keeps timers and lists on disk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lattice.operators import folds

#: Setting of the session that these streams need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: (state or None, a row's values) -> (state, output values or None)
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple | None]]


class _OrderedFold(StatefulProcessor):
    """Rows of a key in order of time: they wait until the watermark has passed them, then the fold sees them one by one."""

    def __init__(self, time: int, waiting: T.StructType, state: T.StructType, outputs: Sequence[str], step: Step, idle_ms: int):
        self.time, self.schema, self.state_schema, self.outputs, self.step, self.idle_ms = time, waiting, state, outputs, step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.folded = handle.getValueState("folded", self.state_schema)
        self.due = handle.getValueState("due", "at long")

    def _at(self, row: tuple) -> int:
        """The first millisecond that is no earlier than the row."""
        return math.ceil(pd.Timestamp(row[self.time]).value / 1e6)

    def _wake(self, at: int) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(None if v is pd.NaT else v for v in r) for frame in rows for r in frame.iloc[:, 1:].itertuples(index=False, name=None)]
        if new:
            idle = not self.waiting.exists()
            self.waiting.appendList(new)
            first = min(map(self._at, new))
            if idle or first < self.due.get()[0]:
                self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        rows = sorted(self.waiting.get(), key=lambda r: (r[self.time], r)) if self.waiting.exists() else []
        ready = [r for r in rows if self._at(r) <= passed]
        left = rows[len(ready) :]
        out = []
        if ready:
            state = self.folded.get() if self.folded.exists() else None
            for row in ready:
                state, given = self.step(state, row)
                if given is not None:
                    out.append((*key, *given))
            self.folded.update(state)
        if left:
            self.waiting.put(left)
            self._wake(self._at(left[0]))
        else:
            self.waiting.clear()
            if ready:
                self._wake(self._at(ready[-1]) + self.idle_ms)
            else:
                self.folded.clear()  # nothing came for the idle time
        if out:
            yield pd.DataFrame(out, columns=self.outputs)

    def close(self) -> None:
        pass


def ordered_fold(events: DataFrame, key: str, time: str, columns: Sequence[str], lateness: str, state: str, output: str, step: Step, idle_seconds: float) -> DataFrame:
    """Fold the rows of each key in order of ``time`` (ties: by the columns as they are listed), whatever batches they come in.

    A row waits until the watermark (``lateness`` behind the latest row of all) has passed it; later ones are dropped by Spark. ``step``
    gets the state (None at first) and the row's time and ``columns``, and gives the new state and the output (without the key) or None. After
    ``idle_seconds`` of event time without a row the state of a key goes. Rows of the last ``lateness`` stay open until more come.
    """
    rows = events.select(key, time, *columns).withWatermark(time, lateness)
    waiting = T.StructType([rows.schema[c] for c in (time, *columns)])
    result = T.StructType([rows.schema[key], *T.StructType.fromDDL(output)])
    fold = _OrderedFold(0, waiting, T.StructType.fromDDL(state), result.names, step, int(idle_seconds * 1000))
    return rows.groupBy(key).transformWithStateInPandas(fold, result, "append", "EventTime")


def _seconds(row: tuple) -> float:
    return pd.Timestamp(row[0]).value / 1e9


def rate_limited(events: DataFrame, per_minute: float, burst: float, key: str = "user_id", time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """(key, event_id, allowed) by a token bucket for each key, whose state goes when the bucket must be full again."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        (tokens, last), allowed = folds.bucket_step(state, _seconds(row), per_minute, burst)
        return (float(tokens), last), (row[1], bool(allowed))

    return ordered_fold(events, key, time, ["event_id"], lateness, "tokens double, last double", "event_id long, allowed boolean", step, 60 * burst / per_minute)


def throttled(events: DataFrame, key: str = "task_id", time: str = "ts", lateness: str = "1 hour", step: float = 5, interval: float = 2, terminal: tuple[str, ...] = folds.FINAL) -> DataFrame:
    """(key, event_id) of the updates that are written; after ``interval`` the next one is written anyway, so the state goes."""
    end = set(terminal)

    def advance(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        last, write = folds.throttle_step(state, _seconds(row), row[2], float(row[3]), end, step, interval)
        return last, (row[1],) if write else None

    return ordered_fold(events, key, time, ["event_id", "status", "progress"], lateness, "t double, status string, progress double", "event_id long", advance, interval)


def state_changes(events: DataFrame, key: str = "task_id", time: str = "ts", lateness: str = "1 hour", keep_seconds: float = 7 * 86400) -> DataFrame:
    """(key, event_id, status, legal): whether each status may follow the one before it; a task without news for ``keep_seconds`` is forgotten."""

    def advance(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        before = state[0] if state else None
        ok = folds.legal(before, row[2])
        return (row[2] if ok else before,), (row[1], row[2], ok)

    return ordered_fold(events, key, time, ["event_id", "status"], lateness, "status string", "event_id long, status string, legal boolean", advance, keep_seconds)


def breaker(events: DataFrame, threshold: int = 3, recovery: float = 30.0, key: str = "user_id", time: str = "ts", lateness: str = "1 hour", keep_seconds: float = 86400) -> DataFrame:
    """(key, event_id, state) of a circuit breaker. Input: also ok and counted (false: a failure that doesn't count)."""

    def advance(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        state, answer = folds.circuit_step(state, _seconds(row), bool(row[2]), bool(row[3]), threshold, recovery)
        return state, (row[1], answer)

    return ordered_fold(events, key, time, ["event_id", "ok", "counted"], lateness, "failures int, opened double", "event_id long, state string", advance, keep_seconds)


# --- documents whose pages come in a stream -------------------------------------------------------


class _Complete(StatefulProcessor):
    """The pages of a document until all are there; a document without a new page for the time to keep is forgotten."""

    def __init__(self, names: Sequence[str], keep_ms: int):
        self.names, self.keep_ms = names, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "text string")
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int | None) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wanted = last = 0
        for frame in rows:
            for page, text, n, at in zip(frame["page"], frame["text"], frame["n_pages"], frame["arrived"], strict=True):
                self.pages.updateValue((int(page),), (text,))
                wanted, last = max(wanted, int(n)), max(last, pd.Timestamp(at).value // 1_000_000)
        held = {k[0]: v[0] for k, v in self.pages.iterator()}
        whole = set(range(1, wanted + 1)) <= set(held)
        self._wake(None if whole else last + self.keep_ms)
        if whole:
            self.pages.clear()
            yield pd.DataFrame([(*key, wanted, "\n".join(held[p] or "" for p in range(1, wanted + 1)))], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.pages.clear()
        self.due.clear()
        yield from ()

    def close(self) -> None:
        pass


def whole_documents(pages: DataFrame, doc_id: str = "doc_id", keep_hours: float = 24, lateness: str = "1 hour") -> DataFrame:
    """(doc_id, n_pages, text) of each document when its last missing page has come, in whatever batches. ``pages``: doc_id, page (from 1), n_pages, text, arrived (a timestamp).

    A page that comes twice counts once, with its last text. State holds open documents only, each for ``keep_hours`` after its
    last page by the pages' own clock.
    """
    rows = pages.select(doc_id, "page", "n_pages", "text", "arrived").withWatermark("arrived", lateness)
    result = T.StructType([rows.schema[doc_id], T.StructField("n_pages", T.IntegerType()), T.StructField("text", T.StringType())])
    return rows.groupBy(doc_id).transformWithStateInPandas(_Complete(result.names, int(keep_hours * 3_600_000)), result, "append", "EventTime")


def page_stream(spark, path: str, schema: str, files_a_trigger: int = 8) -> DataFrame:
    """Page files of a folder as a stream that takes a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def write_batches(stream: DataFrame, path: str, checkpoint: str, before: Callable[[int], None] | None = None):
    """Write each batch to a folder of its own number: a batch that is repeated after a failure replaces what it had written.

    Read the folders with ``spark.read.parquet(path)``; the number is the column ``batch``. ``before`` is called with the number first.
    """

    def put(rows: DataFrame, number: int) -> None:
        if before is not None:
            before(number)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
