"""Selections whose state depends on earlier decisions: one pandas call per key, rows in a stated order.

A key is one request, video or task, bounded by its nature; keys run in parallel.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Container, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Apply ``step`` to the rows of each key, sorted by ``order`` (which must decide every tie)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(list(order), kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def fold_column(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], decide: Callable[..., list], name: str, kind: T.DataType) -> DataFrame:
    """Add one column: ``decide`` gets the inputs of one key as lists, in order, and returns a value for each row.

    For many small keys: rows are dealt out and sorted by key in the JVM, and each task walks over its runs of equal
    keys, with no frame or Arrow stream for every key.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the key that may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, final = _starts(batch, keys)
            if held and last != _key(batch, keys, 0):
                yield from decided(pa.Table.from_batches(held), [0]).to_batches()
                held = []
            if held and len(starts) > 1:
                yield from decided(pa.Table.from_batches([*held, batch.slice(0, starts[1])]), [0]).to_batches()
                held, batch, starts = [], batch.slice(starts[1]), [s - starts[1] for s in starts[1:]]
            if len(starts) > 1:
                yield from decided(pa.Table.from_batches([batch.slice(0, starts[-1])]), starts[:-1]).to_batches()
            held.append(batch.slice(starts[-1]) if not held else batch)
            last = final
        if held:
            yield from decided(pa.Table.from_batches(held), [0]).to_batches()

    def decided(table: pa.Table, starts: list[int]) -> pa.Table:
        lists = [table.column(c).to_pylist() for c in inputs]
        out: list = []
        for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
            out += decide(*(values[a:b] for values in lists))
        return table.append_column(name, pa.array(out, to_arrow_type(kind)))

    return dealt.mapInArrow(walk, schema)


def _key(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[list[int], tuple]:
    """Where runs of equal keys begin, and the last key."""
    columns = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
    return [i for i, k in enumerate(columns) if i == 0 or k != columns[i - 1]], columns[-1]


def bucket_step(state: tuple | None, t: float, per_minute: float, burst: float) -> tuple[tuple, bool]:
    """(tokens, time) after a request, and whether it passes."""
    tokens, last = state or (burst, t)
    tokens = min(burst, tokens + (t - last) * per_minute / 60)
    return (tokens - (tokens >= 1), t), tokens >= 1


def token_bucket(times: Sequence[float], per_minute: float, burst: float) -> list[bool]:
    """Which requests pass: the bucket refills per_minute / 60 a second up to ``burst``, a pass takes one."""
    state, out = None, []
    for t in times:
        state, allowed = bucket_step(state, t, per_minute, burst)
        out.append(allowed)
    return out


def throttle_step(last: tuple | None, t: float, status: str, progress: float, end: Container[str], step: float, interval: float) -> tuple[tuple, bool]:
    """The last written update after this one, and whether this one is written."""
    write = last is None or status in end or status != last[1] or abs(progress - last[2]) >= step or t - last[0] >= interval
    return ((t, status, progress) if write else last), write


def throttle(times: Sequence[float], status: Sequence[str], progress: Sequence[float], terminal: Iterable[str], step: float = 5, interval: float = 2) -> list[bool]:
    """Which updates are written: the first, terminal ones, changes of status, progress steps, or after the interval."""
    end, out, last = set(terminal), [], None
    for t, s, p in zip(times, status, progress, strict=True):
        last, write = throttle_step(last, t, s, p, end, step, interval)
        out.append(write)
    return out


#: Status changes that a task may make; ``failed`` may follow any status but the final ones.
TRANSITIONS = {"queued": {"parsing"}, "parsing": {"extracting"}, "extracting": {"structuring"}, "structuring": {"storing"}, "storing": {"completed"}}
FINAL = ("completed", "failed")


def legal(before: str | None, after: str) -> bool:
    return after == "queued" if before is None else after in TRANSITIONS.get(before, set()) or (after == "failed" and before not in FINAL)


def circuit_step(state: tuple | None, t: float, good: bool, counted: bool, threshold: int, recovery: float) -> tuple[tuple, str]:
    """(failures, time of opening or -1) after a call, and the state in which it is answered."""
    failures, opened = state or (0, -1.0)
    if opened >= 0 and t - opened < recovery:
        return (failures, opened), "open"
    answer = "closed" if opened < 0 else "half_open"
    if good:
        return (0, -1.0), answer
    failures += counted
    return (failures, float(t) if opened >= 0 or failures >= threshold else -1.0), answer


def circuit(times: Sequence[float], ok: Sequence[bool], threshold: int = 3, recovery: float = 30.0, counted: Sequence[bool] | None = None) -> list[str]:
    """State in which each call is answered: closed, open (refused) or half_open (the probe). A failed probe opens again.

    A failure that is not ``counted`` leaves the count as it is (as a probe it still opens again).
    """
    out, state = [], None
    for i, (t, good) in enumerate(zip(times, ok, strict=True)):
        state, answer = circuit_step(state, t, good, counted is None or bool(counted[i]), threshold, recovery)
        out.append(answer)
    return out


def cooldown_circuit(times: Sequence[float], ok: Sequence[bool], threshold: int = 5, cooldown: float = 60.0) -> list[str]:
    """The form without a probe: after the cooldown everything is as new."""
    out, failures, opened = [], 0, None
    for t, good in zip(times, ok, strict=True):
        if opened is not None and t - opened >= cooldown:
            failures, opened = 0, None
        out.append("closed" if opened is None else "open")
        if opened is None:
            failures = 0 if good else failures + 1
            opened = t if failures >= threshold else None
    return out


def lpt(costs: Sequence[int], capacity: int, load: float = 0.65) -> list[int]:
    """Bin of each cost, longest first into the least loaded bin (the first of equals) that still holds it.

    As many bins as the target load (capacity x load, .1 to 1) asks for stand open from the start, so loads level out; a
    cost that fits none of them opens another. A cost above the capacity is an error.
    """
    if any(c > capacity for c in costs):
        raise ValueError("an item does not fit any bin")
    target = max(1, int(capacity * min(1.0, max(0.1, load))))
    bins, out = [0] * min(len(costs), max(1, -(-sum(costs) // target))), [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        k = min((k for k, b in enumerate(bins) if b + costs[i] <= capacity), key=lambda k: (bins[k], k), default=len(bins))
        if k == len(bins):
            bins.append(0)
        bins[k] += costs[i]
        out[i] = k
    return out


def consume_plans(plans: Sequence[str], costs: Sequence[int], limit: int) -> list[int | None]:
    """Place at which each item is taken, else None. Every round tries the head of each plan in turn; a round that takes nothing is the last."""
    waiting: dict[str, list[int]] = {}
    for i, p in enumerate(plans):
        waiting.setdefault(p, []).insert(0, i)
    out: list[int | None] = [None] * len(plans)
    used = taken = 0
    before = -1
    while taken > before and waiting:
        before = taken
        for p, items in list(waiting.items()):
            if used + costs[items[-1]] <= limit:
                i = items.pop()
                used, taken, out[i] = used + costs[i], taken + 1, taken
            if not items:
                del waiting[p]
    return out


def budget_merge(groups: Sequence[str], tokens: Sequence[int], gains: Sequence[float], budget: int, most: int) -> list[bool]:
    """Which candidates stay: the best of each group first, then by gain; what exceeds the budget is skipped, not the end."""
    order = sorted(range(len(tokens)), key=lambda i: (-gains[i], i))
    first, seen = [], set()
    for i in order:
        if groups[i] not in seen:
            seen.add(groups[i])
            first.append(i)
    out, used, n = [False] * len(tokens), 0, 0
    for i in [*first, *(i for i in order if i not in set(first))]:
        if n < most and used + tokens[i] <= budget:
            out[i], used, n = True, used + tokens[i], n + 1
    return out


def mmr(vectors: np.ndarray, importance: np.ndarray, k: int, w_generic: float = 0.3, w_similar: float = 0.5) -> list[int]:
    """Greedy representatives: importance less genericness less the largest similarity to those chosen."""
    if not len(vectors):
        return []
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    similar = unit @ unit.T
    np.fill_diagonal(similar, 0)
    generic, nearest, chosen = similar.mean(1), np.zeros(len(unit)), []
    for _ in range(min(k, len(unit))):
        score = np.round(importance - w_generic * generic - w_similar * nearest, 9)
        score[chosen] = -np.inf
        chosen.append(int(score.argmax()))
        nearest = np.maximum(nearest, similar[chosen[-1]])
    return chosen


def merge_short(sizes: Sequence[float], least: float) -> list[int]:
    """Segment of each item: extended until it is long enough; a short tail joins the one before."""
    out, segment, size = [], 0, 0.0
    for s in sizes:
        out.append(segment)
        size += s
        if size >= least:
            segment, size = segment + 1, 0.0
    if size and segment:
        out = [min(s, segment - 1) for s in out]
    return out


def sentence_groups(seconds: Sequence[float], chars: Sequence[int], least: float, most: float, most_chars: int) -> list[int]:
    """Group of each sentence: one goes on while it is shorter than ``least`` and the next keeps it below both upper limits.

    A last group that is still too short joins the one before, if both together stay below the limits.
    """
    groups: list[list] = []  # sentences, seconds, characters, open
    for i, (d, c) in enumerate(zip(seconds, chars, strict=True)):
        last = groups[-1] if groups else None
        if last and last[3] and last[1] < least and last[2] < most_chars and last[1] + d < most and last[2] + c < most_chars:
            last[:3] = [*last[0], i], last[1] + d, last[2] + c
        else:
            groups.append([[i], d, c, d < most and c < most_chars])
    if len(groups) > 1 and groups[-1][3] and groups[-1][1] < least and groups[-1][2] < most_chars and groups[-2][1] + groups[-1][1] < most and groups[-2][2] + groups[-1][2] < most_chars:
        groups[-2][0] += groups.pop()[0]
    return [g for g, (members, *_) in enumerate(groups) for _ in members]


def merge_scenes(starts: Sequence[int], ends: Sequence[int], confidence: Sequence[float], summary: Sequence[str | None], least: int) -> list[tuple[int, int, float, str | None]]:
    """Scenes of at least ``least`` frames: (start, end, least confidence, summaries joined by `` / ``). A short tail joins the scene before."""

    def join(a: tuple, b: tuple) -> tuple:
        texts = [t for t in (a[3], b[3]) if t]
        return a[0], b[1], min(a[2], b[2]), " / ".join(dict.fromkeys(texts)) if texts else None

    out: list[tuple] = []
    for scene in zip(starts, ends, confidence, summary, strict=True):
        if out and out[-1][1] - out[-1][0] < least:
            out[-1] = join(out[-1], scene)
        else:
            out.append(scene)
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        tail = out.pop()
        out[-1] = join(out[-1], tail)
    return out


def page_groups(tokens: Sequence[int], target: int, overlap: int = 1) -> list[tuple[int, int]]:
    """Token-balanced runs of pages (first, last). A run is cut before the page that takes it above the mean of target and
    equal share; the next begins ``overlap`` pages earlier. A first page that alone is above it leaves a run without pages, (0, -1)."""
    total = sum(tokens)
    if total <= target:
        return [(0, len(tokens) - 1)] if tokens else []
    parts = math.ceil(total / target)
    average = math.ceil((total / parts + target) / 2)
    out, start, size = [], 0, 0
    for i, n in enumerate(tokens):
        if size + n > average:
            out.append((start, i - 1))
            start = max(i - overlap, 0)
            size = sum(tokens[start:i])
        size += n
    return [*out, (start, len(tokens) - 1)]


_SENTENCE_END = re.compile(r"[。！？!?；;.]\s*$")


def utterances(starts: Sequence[float], ends: Sequence[float], speakers: Sequence[str | None], texts: Sequence[str | None], longest: float = 30, least: float = 5, gap: float = 0.8) -> list[int | None]:
    """Unit of each sentence in order of start and end (None for blank or empty ones, which take no part): a unit ends where the
    next would make it longer than ``longest`` seconds, or from ``least`` on at a gap, between two known speakers or at a sentence end."""
    out: list[int | None] = [None] * len(starts)
    unit, begin, before = 0, None, None
    for i in sorted((i for i in range(len(starts)) if ends[i] > starts[i] and (texts[i] or "").strip()), key=lambda i: (starts[i], ends[i], i)):
        if before is not None:
            span = ends[before] - begin
            change = bool(speakers[before] and speakers[i] and speakers[before] != speakers[i])
            broken = starts[i] - ends[before] >= gap or change or bool(_SENTENCE_END.search(texts[before]))
            if ends[i] - begin > longest or (span >= least and broken):
                unit, begin = unit + 1, None
        begin = starts[i] if begin is None else begin
        out[i], before = unit, i
    return out


def edit_log(kinds: Sequence[str], values: Sequence[str], expected: Sequence[int | None], history: int = 50) -> list[tuple[int, str | None, bool]]:
    """(revision, value, accepted) after each of apply, undo and redo. A wrong expected revision is refused (None expects none); an edit that changes nothing keeps the revision; a new edit clears redo."""
    revision, value, undo, redo, out = 0, None, [], [], []
    for kind, v, e in zip(kinds, values, expected, strict=True):
        accepted = e is None or e == revision
        if accepted and kind == "apply" and v != value:
            undo, redo, value, revision = [*undo, value][-history:], [], v, revision + 1
        elif accepted and kind == "undo" and undo:
            redo.append(value)
            value, revision = undo.pop(), revision + 1
        elif accepted and kind == "redo" and redo:
            undo.append(value)
            value, revision = redo.pop(), revision + 1
        out.append((revision, value, accepted))
    return out


def xy_cut(boxes: Sequence[tuple[float, float, float, float]]) -> list[int]:
    """Reading order of boxes: recursive cuts at the largest gap of either projection; leaves by y, then x."""

    def widest(indices: list[int], axis: int) -> tuple[float, float]:
        spans = sorted((boxes[i][axis], boxes[i][axis + 2]) for i in indices)
        best, at, end = 0.0, 0.0, spans[0][1]
        for a, b in spans[1:]:
            if a - end > best:
                best, at = a - end, (a + end) / 2
            end = max(end, b)
        return best, at

    def order(indices: list[int]) -> list[int]:
        if len(indices) < 2:
            return indices
        (gx, x), (gy, y) = widest(indices, 0), widest(indices, 1)
        if gx <= 0 and gy <= 0:
            return sorted(indices, key=lambda i: (boxes[i][1], boxes[i][0], i))
        axis, at = (1, y) if gy >= gx else (0, x)
        return order([i for i in indices if boxes[i][axis] < at]) + order([i for i in indices if boxes[i][axis] >= at])

    return order(list(range(len(boxes))))


def text_lines(spans: Sequence[tuple[float, float]], share: float = 0.6) -> list[int]:
    """Line of each (top, bottom) span, by top: a span joins the line whose last span it overlaps by more than ``share`` of the lower height."""
    out, line, last = [0] * len(spans), -1, None
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0], i)):
        top, bottom = spans[i]
        joins = last is not None and min(bottom, last[1]) - max(top, last[0]) > share * min(bottom - top, last[1] - last[0])
        line += not joins
        out[i], last = line, (top, bottom)
    return out


def expand_optional(covered: Sequence[bool], scores: Sequence[float], sizes: Sequence[int], gap: int, least: float) -> list[bool]:
    """Possible documents that fill what is left: uncovered ones first, then by score; those below ``least`` or beyond the gap are passed over."""
    out, used = [False] * len(scores), 0
    for i in sorted(range(len(scores)), key=lambda i: (covered[i], -scores[i], i)):
        if scores[i] >= least and used < gap and used + sizes[i] <= gap:
            out[i], used = True, used + sizes[i]
    return out
