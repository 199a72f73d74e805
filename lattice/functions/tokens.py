"""Token counts by byte-pair merges in order of rank, and windows of bounded token counts."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pattern that splits texts before the merges of the common byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a task remembers.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file (base 64, blank, number)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece: the neighbours whose union has the least rank become one, the first of equals, until none has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [piece]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Counter:
    """Counts tokens of texts; pieces come again and again, so their counts are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split, self.known = ranks, regex.compile(pattern), {}

    def piece(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(merged(piece.encode(), self.ranks))
        return n

    def count(self, text: str, start: int = 0, end: int | None = None) -> int:
        """Tokens of text[start:end]."""
        return sum(self.piece(m.group()) for m in self.split.finditer(text[start:end] if end is not None or start else text))

    def windows(self, text: str, most: int, overlap: float = 0.1) -> Iterator[tuple[int, int, int]]:
        """(start, end, tokens) of windows of at most ``most`` tokens, each beginning a share of the one before it back from its end.

        The end is found by halving, as counts of prefixes mostly grow. Pieces well inside a prefix are those of the whole
        rest, so only its last ones are counted anew.
        """
        if not text:
            yield 0, 0, 0
            return
        start = 0
        while True:
            ends, sums = [start], [0]
            for m in self.split.finditer(text, start):
                ends.append(m.end())
                sums.append(sums[-1] + self.piece(m.group()))
                # no end lies beyond: the last piece alone would pass the budget by far
                if sums[-1] > 2 * most + 64 and start:
                    break

            def prefix(end: int, ends: list[int] = ends, sums: list[int] = sums, start: int = start) -> int:
                # the piece before the end, and what looks one character ahead, may be cut otherwise
                k = max(0, bisect_right(ends, end - 1) - 1)
                return sums[k] + self.count(text, ends[k], end)

            if start == 0 and sums[-1] <= most:
                yield 0, len(text), sums[-1]
                return
            low, high, best = start + 1, len(text), start
            while low <= high:
                middle = (low + high) // 2
                # beyond the counted pieces the budget is passed in any case
                fits = middle <= ends[-1] and prefix(middle) <= most
                low, high, best = (middle + 1, high, middle) if fits else (low, middle - 1, best)
            if best == start:
                raise ValueError("a single character exceeds the token budget")
            yield start, best, prefix(best)
            if best == len(text):
                return
            back = max(1, int((best - start) * overlap)) if overlap else 0
            start = max(start + 1, best - back)


def _each(docs: DataFrame, doc_id: str, text: str, ranks: dict[bytes, int], schema: T.StructType, rows) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            own = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows(counter, t or "")]
            columns = list(zip(*own, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(0).type if i == 0 else pa.string() if f.dataType == T.StringType() else pa.int64()) for i, (c, f) in enumerate(zip(columns, schema, strict=True))], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def token_counts(docs: DataFrame, doc_id: str, text: str, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens); null texts have none. The ranks (a vocabulary file, some megabytes) travel to the tasks."""
    schema = T.StructType([docs.schema[doc_id], T.StructField("n_tokens", T.LongType())])
    return _each(docs, doc_id, text, ranks, schema, lambda counter, t: [(counter.count(t),)])


def token_windows(docs: DataFrame, doc_id: str, text: str, ranks: dict[bytes, int], most: int, overlap: float = 0.1) -> DataFrame:
    """(doc_id, window, start, n_tokens, text): windows of at most ``most`` tokens of each text, ``overlap`` of the one before repeated; an empty text is one empty window."""
    share = min(0.5, max(0.0, overlap))
    schema = T.StructType([docs.schema[doc_id], *T.StructType.fromDDL("window long, start long, n_tokens long, text string").fields])
    return _each(docs, doc_id, text, ranks, schema, lambda counter, t: [(i, a, n, t[a:b]) for i, (a, b, n) in enumerate(counter.windows(t, max(1, most), share))])
