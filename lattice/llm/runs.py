"""Periodic runs of words: a harmonic grid of position pairs, longest common extensions by suffix arrays and range minima."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import flat, map_arrow, slices, word_bounds, word_hashes

#: Words of the shortest run.
SHORTEST = 12
#: Grid pairs that are looked at together.
GRID_PAIRS = 1 << 20
_FAR = np.iinfo(np.int32).max


# --- longest common extensions -------------------------------------------------------------------


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low : high + 1]) of each query, low <= high.

    The levels of a sparse table are made one after the other; each answers the queries of its width, so one level is held.
    """
    out = np.full(len(low), _FAR, np.int32)
    if not len(low):
        return out
    level = np.frexp(high - low + 1)[1] - 1
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    row = values
    for k in range(len(bounds) - 1):
        if k:
            row = np.minimum(row[: -(1 << (k - 1))], row[1 << (k - 1) :])
        q = order[bounds[k] : bounds[k + 1]]
        if len(q):
            out[q] = np.minimum(row[low[q]], row[high[q] - (1 << k) + 1])
    return out


class Extensions:
    """Suffix ranks and common-prefix lengths of one sequence of codes; ``of`` answers longest common extensions.

    Prefix doubling: a round sorts the suffixes of groups not yet single by the rank ``k`` words further on. Where a group falls
    apart, the common prefix is k words and what the range minimum over the lengths known so far says of the suffixes there.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        ordered = codes[order]
        first = np.ones(n, bool)
        first[1:] = ordered[1:] != ordered[:-1]
        #: rank: place of the first suffix of the own group; one past the end stands before all
        self.rank = np.full(n + 1, -1, np.int32)
        self.rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        #: common prefix with the suffix one place before
        self.common = np.where(first, 0, _FAR).astype(np.int32)
        single = first.copy()
        single[:-1] &= first[1:]
        left, k = order[~single], 1
        while len(left):
            following = self.rank[np.minimum(left + k, n)]
            key = self.rank[left].astype(np.int64) * (n + 1) + following + 1
            by = np.argsort(key)
            left, key = left[by], key[by]
            group = self.rank[left]
            new_group = np.ones(len(left), bool)
            new_group[1:] = group[1:] != group[:-1]
            new_part = np.ones(len(left), bool)
            new_part[1:] = key[1:] != key[:-1]
            at = np.arange(len(left))
            begin = np.maximum.accumulate(np.where(new_group, at, 0))
            split = np.flatnonzero(new_part & ~new_group)
            x, y = following[by][split - 1], following[by][split]
            # parts of a group come in order of what follows, so x < y
            inside = x >= 0
            length = np.full(len(split), k, np.int32)
            length[inside] += range_minima(self.common, x[inside] + 1, y[inside])
            self.common[group[split] + (split - begin[split])] = length
            self.rank[left] = group + (np.maximum.accumulate(np.where(new_part, at, 0)) - begin)
            alone = new_part.copy()
            alone[:-1] &= new_part[1:]
            left = left[~alone]
            k *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal codes from a and from b onwards (a != b)."""
        x, y = self.rank[a], self.rank[b]
        return range_minima(self.common, np.minimum(x, y) + 1, np.maximum(x, y))


# --- runs ---------------------------------------------------------------------------------------


def _grid(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) for every multiple jp of every period p up to half of its document, where (j+1)p is inside; in blocks."""
    half = sizes // 2
    doc = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (sizes[doc] - 1) // period
    total = np.cumsum(count)
    at = 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + GRID_PAIRS, "right")))
        c = count[at:end]
        p = np.repeat(period[at:end], c)
        step = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(starts[doc[at:end]], c) + step * p, p
        at = end


def find_runs(codes: np.ndarray, firsts: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of every run of every document, by start, then period; starts count through all documents.

    ``codes`` holds equal numbers where words of one document are equal, and none twice in different documents. A run of
    period p has two periods at least, so it holds a multiple jp of p and (j+1)p: their common extensions to both sides are the
    run. Pairs of unequal words extend nowhere and are left out before. A repetition found under a multiple of its smallest
    period has the same bounds, of which the smallest period stays.
    """
    sizes = np.diff(firsts)
    fit = sizes >= shortest
    found = []
    ahead = behind = None
    n = len(codes)
    for a, p in _grid(sizes[fit], firsts[:-1][fit]):
        same = np.flatnonzero(codes[a] == codes[a + p])
        if not len(same):
            continue
        if ahead is None:
            ahead, behind = Extensions(codes), Extensions(codes[::-1])
        a, p = a[same], p[same]
        onwards = ahead.of(a, a + p)
        # the last word of the reversed sequence is the first here: both words are equal, so the extension holds a itself
        back = behind.of(n - 1 - a, n - 1 - a - p) - 1
        length = p + onwards + back
        long = length >= np.maximum(shortest, 2 * p)
        found.append((a[long] - back[long], length[long], p[long]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def tail_period(n: int, h: int) -> tuple[int, int] | None:
    """Where the words of a document with the hash h begin to recur, and after how many words; None where they don't."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = False, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256,
    collapsed_sha256 and, with ``keep_text``, runs (an array of start, length and period) and collapsed_text.

    Words are maximal runs of bytes other than blanks and 0x09 to 0x0D, unchanged. A run is a stretch of words with smallest
    period q and at least max(12, 2q) words that can't be extended; a word goes if a run holds it after the run's first
    q words. With ``tails`` one document in ten (by crc32 of its id) gets a recurring tail first: a test load. The longest run
    of equal ones is the first, then the one of the smaller period. Null and empty texts have no words; a null id counts as the
    empty text; repeated rows get equal values. Other columns are not read; an empty table gives no rows.

    Nothing is shuffled: a task looks at texts of 1 MB together, or at one longer text, whose memory grows with its words.
    Words are told apart by 64-bit hashes (exact up to eight bytes).
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType())]
    run_type = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    out = T.StructType([picked.schema["doc_id"], *(T.StructField(n, k) for n, k in fields)])
    if keep_text:
        out = out.add("runs", T.ArrayType(run_type)).add("collapsed_text", T.StringType())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(_looked(batch, tails, keep_text), names=out.names)

    return map_arrow(picked, look, out)


def _looked(batch: pa.RecordBatch, tails: bool, keep_text: bool) -> list[pa.Array]:
    data, offsets = flat(batch.column("text"))
    starts, ends, firsts = word_bounds(data, offsets)
    sizes = np.diff(firsts)
    order = np.arange(len(starts))
    moved: dict[int, tuple[int, int]] = {}
    if tails:
        for d, (i, n) in enumerate(zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True)):
            if (tail := tail_period(n, zlib.crc32(b"" if i is None else str(i).encode()))) is not None:
                a, p = tail
                order[firsts[d] + a : firsts[d + 1]] = firsts[d] + a + np.arange(n - a) % p
                moved[d] = tail
    # equal words of one document, and of no other, have equal numbers
    words = np.unique(word_hashes(data, starts, ends), return_inverse=True)[1][order]
    codes = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max(initial=0)) + 1) + words
    start, length, period = find_runs(codes, firsts)
    bounds = np.searchsorted(start, firsts)
    marks = np.zeros(len(starts) + 1, np.int32)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    gone = np.cumsum(marks[:-1]) > 0
    best: list[list[int | None]] = [[], [], [], []]
    n_runs, runs_sha, kept_sha, lists, texts = [], [], [], [], []
    nothing = hashlib.sha256(b"").hexdigest()
    for d in range(len(sizes)):
        u, v = int(bounds[d]), int(bounds[d + 1])
        split = data[offsets[d] : offsets[d + 1]].tobytes().split()
        if d in moved:
            split = [split[i] for i in (order[firsts[d] : firsts[d + 1]] - firsts[d]).tolist()]
        n_runs.append(v - u)
        if u == v:
            runs_sha.append(nothing)
            for column in best:
                column.append(None)
            lists.append([])
        else:
            own = list(zip((start[u:v] - firsts[d]).tolist(), length[u:v].tolist(), period[u:v].tolist(), strict=True))
            s, n, p = min(own, key=lambda r: (-r[1], r[0], r[2]))
            for column, value in zip(best, (s, n, p, 1000 * n // p), strict=True):
                column.append(value)
            runs_sha.append(hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in own).encode()).hexdigest())
            split = [w for w, g in zip(split, gone[firsts[d] : firsts[d + 1]].tolist(), strict=True) if not g]
            lists.append([{"start": x, "length": y, "period": z} for x, y, z in own])
        kept = b" ".join(split)
        kept_sha.append(hashlib.sha256(kept).hexdigest())
        if keep_text:
            texts.append(kept.decode())
    columns = [batch.column("doc_id"), pa.array(n_runs, pa.int64()), *(pa.array(c, pa.int64()) for c in best), pa.array(runs_sha, pa.string()), pa.array(kept_sha, pa.string())]
    if keep_text:
        columns += [pa.array(lists, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), pa.array(texts, pa.string())]
    return columns
