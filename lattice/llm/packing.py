"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import bound_batches, map_arrow, release, slices, written

#: Pieces that are packed together; one task holds a few of these groups.
PIECES_PER_BLOCK = 4096
#: Cuts of a document lie at multiples of this many tokens after its last full window.
GRAIN = 32
#: Windows with at most this much slack are left as they are.
TOLERANCE = 16
#: Bytes (strings, tokens and what Python adds to them) of the chunks whose tokens a worker remembers.
CACHE_BYTES = 64 << 20
_ENTRY_BYTES = 190

# --- tokens ----------------------------------------------------------------------------------

#: Chunks that the tokenizer never joins to their neighbours, in texts that `_plain` accepts: a run of Latin letters that no
#: other letter follows, a line feed, or other characters, the first and last with at most one space before them.
_CHUNK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?![^\W\d_])|\n| ?[^ \n]+")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Bytes of controls, and lead bytes of every white space and format character beyond ASCII.
_SUSPECT = bytes([*range(10), *range(11, 32), 127, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u00ad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")


def _plain(text: str) -> bool:
    """Whether all white space is single spaces before words and single line feeds between lines."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text.endswith(" "):
        return False
    raw = text.encode()
    return len(raw.translate(None, _SUSPECT)) == len(raw) or not _ODD.search(text)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = {}, 256
    for byte in range(256):
        out[byte] = chr(byte if byte in printable else spare)
        spare += byte not in printable
    return out


class _Chunks(dict[str, bytes]):
    """Tokens of chunks, asked of ``learn`` when first wanted; starts afresh beyond CACHE_BYTES."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn, self.held = learn, 0

    def __missing__(self, chunk: str) -> bytes:
        found = self.learn(chunk)
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self[chunk] = found
        self.held += len(chunk) + len(found) + _ENTRY_BYTES
        return found


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes; chunks that recur are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark's tasks have the cores already: threads of each task's own would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()
        self.chunks = _Chunks(self._learn)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, chunk: str) -> bytes:
        """Encode a chunk; one run of letters is one word to the model, without the steps before it."""
        if not _LETTERS.fullmatch(chunk):
            return self._encode([chunk])[0]
        tokens = self.tokenizer.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.chunks.__getitem__
        out = [b"".join(map(known, _CHUNK.findall(t))) if _plain(t) else None for t in texts]
        whole = iter(self._encode([t for t, found in zip(texts, out, strict=True) if found is None]))
        return [next(whole) if found is None else found for found in out]


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


# --- CRC-32 of parts -------------------------------------------------------------------------


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@lru_cache(maxsize=4096)
def _zeros(n: int) -> tuple[int, ...]:
    """The linear map on CRC-32 states that n zero bytes make, as images of the 32 unit vectors."""
    if n == 1:
        step = []
        for i in range(32):
            state = 1 << i
            for _ in range(8):
                state = (state >> 1) ^ (0xEDB88320 if state & 1 else 0)
            step.append(state)
        return tuple(step)
    half = _zeros(n // 2)
    out = [_times(list(half), v) for v in half]
    return tuple(_times(list(_zeros(1)), v) for v in out) if n % 2 else tuple(out)


def crc_of_part(crc_before: int, crc_through: int, n_bytes: int) -> int:
    """CRC-32 of the last n_bytes, from those of what stands before them and of both together."""
    return crc_through if not n_bytes else crc_through ^ _times(list(_zeros(n_bytes)), crc_before)


# --- minimum bin slack -----------------------------------------------------------------------


def fill_window(counts: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, among those with counts, whose sum comes closest to capacity from below.

    Subset sums are bits of one integer; a length with count c enters as blocks of 1, 2, 4, ... of itself. The largest
    length that fits is always in (the window has to take it some time). The bits before each block are kept, and
    walking back through them gives the counts of each length. Stops at the first exact fit.
    """
    anchor = next((n for n in range(min(capacity, len(counts) - 1), 0, -1) if counts[n]), 0)
    if not anchor:
        return {}
    limit = (1 << (capacity + 1)) - 1
    reach = 1 << anchor
    steps: list[tuple[int, int, int]] = []
    for length in range(min(anchor, capacity - anchor), 0, -1):
        left = min(counts[length] - (length == anchor), (capacity - anchor) // length)
        block = 1
        while left > 0 and not reach >> capacity & 1:
            take = min(block, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & limit
            left -= take
            block *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen = {anchor: 1}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


class Piece:
    __slots__ = ("doc", "start", "length", "crc_before", "marks", "total")

    def __init__(self, doc, start: int, length: int, crc_before: int, marks: list[int], total: int):
        #: marks[i]: CRC-32 from the start of the document's rest through min(crc offset + (i + 1) * GRAIN, end) tokens
        self.doc, self.start, self.length, self.crc_before, self.marks, self.total = doc, start, length, crc_before, marks, total

    @property
    def crc(self) -> int:
        return crc_of_part(self.crc_before, self.marks[-1], 4 * self.length)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """Two pieces, the first of n tokens, n a multiple of GRAIN."""
        k = n // GRAIN
        first = Piece(self.doc, self.start, n, self.crc_before, self.marks[:k], self.total)
        return first, Piece(self.doc, self.start + n, self.length - n, self.marks[k - 1], self.marks[k:], self.total)


def pack_block(items: list[Piece], capacity: int) -> Iterator[list[Piece]]:
    """Windows of pieces. Each takes the best multiset; what is still missing beyond TOLERANCE is cut from a longer piece."""
    shelves: list[list[Piece]] = [[] for _ in range(capacity + 1)]
    for p in items:
        shelves[p.length].append(p)
    counts = [len(s) for s in shelves]
    rest = len(items)
    while rest:
        chosen = fill_window(counts, capacity)
        repeat = max(1, min(counts[n] // c for n, c in chosen.items()))
        slack = capacity - sum(n * c for n, c in chosen.items())
        if slack > TOLERANCE:
            repeat = 1
        for _ in range(repeat):
            window = []
            for n, c in chosen.items():
                for _ in range(c):
                    window.append(shelves[n].pop())
                counts[n] -= c
                rest -= c
            part = slack // GRAIN * GRAIN
            if slack > TOLERANCE and part:
                longer = next((n for n in range(capacity, part, -1) if counts[n]), 0)
                if longer:
                    head, tail = shelves[longer].pop().cut(part)
                    counts[longer] -= 1
                    window.append(head)
                    shelves[tail.length].append(tail)
                    counts[tail.length] += 1
            yield window


# --- the operator ----------------------------------------------------------------------------

_PIECE_FIELDS = (("doc_id", None), ("start", T.LongType()), ("length", T.LongType()), ("crc", T.LongType()), ("marks", T.ArrayType(T.LongType())), ("doc_tokens", T.LongType()), ("hash", T.LongType()))


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer_path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is its token
    ids and ``end_id``; full windows are cut off first, its rest is packed by minimum bin slack with the rests of other
    documents, cut again only where no multiset of rests fills a window. A null or empty text is the end id alone.
    Rows that repeat an id are separate documents with equal ids. Columns other than the two named are not read. An
    empty table gives no rows.

    Texts are read and tokenised once, in place; only pieces (some tens of bytes each) are written and dealt out, by a
    hash of document, piece and place in that table (so neither a long document nor a row that repeats gathers in one
    block), to blocks of about PIECES_PER_BLOCK. Blocks pack on their own, so memory is bounded and the
    padding that the last window of each block needs stays below 0.1 %.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    schema = T.StructType([T.StructField(n, k or docs.schema[id_col].dataType) for n, k in _PIECE_FIELDS])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        end = np.array([end_id], "<u4").tobytes()
        for whole in slices(batches, 1):
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, columns = [], ([], [], [], [], [])
                for i, ids in enumerate(tokens.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids = ids + end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        marks, crc = [], 0
                        if len(piece) < 4 * capacity:
                            for b in range(0, len(piece), 4 * GRAIN):
                                crc = zlib.crc32(piece[b : b + 4 * GRAIN], crc)
                                marks.append(crc)
                        else:
                            crc = zlib.crc32(piece)
                        rows.append(i)
                        for c, v in zip(columns, (start, len(piece) // 4, crc, marks, n), strict=True):
                            c.append(v)
                take = pa.array(rows, pa.int64())
                ids_column = batch.column(0).take(take)
                arrays = [ids_column, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, batch.column(2).take(take)], schema.names)

    spread = F.xxhash64(F.col(id_col), F.col(text_col))
    found = written(map_arrow(docs.select(F.col(id_col), F.col(text_col), spread), cut, schema), "pieces")
    blocks = max(1, math.ceil(found.count() / PIECES_PER_BLOCK))
    out = T.StructType([schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def pack(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("hash", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        columns = [table.column(n).to_pylist() for n in ("start", "length", "crc", "marks", "doc_tokens")]
        rows, rests, sequence = ([], [], [], [], [], [], []), [], keys[0].as_py() << 32

        def put(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length, crc, total in window:
                for c, v in zip(rows, (doc, start, length, crc, total, sequence, offset), strict=True):
                    c.append(v)
                offset += length
            sequence += 1

        for i, (start, length, crc, marks, total) in enumerate(zip(*columns, strict=True)):
            if length == capacity:
                put([(i, start, length, crc, total)])
            else:
                rests.append(Piece(i, start, length, 0, marks, total))
        for window in pack_block(rests, capacity):
            put([(p.doc, p.start, p.length, p.crc, p.total) for p in window])
        ids = table.column("doc_id").take(pa.array(rows[0], pa.int64()))
        release()
        return pa.table([ids, *(pa.array(c, pa.int64()) for c in rows[1:])], names=out.names)

    bound_batches(docs.sparkSession)
    place = F.xxhash64("hash", "start", F.monotonically_increasing_id())
    return found.withColumn("_block", F.pmod(place, F.lit(blocks)).cast("long")).groupBy("_block").applyInArrow(pack, out)
