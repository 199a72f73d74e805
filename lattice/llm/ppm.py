"""Language-model scoring by prediction by partial matching: a pretrained byte-context trie with escapes and symbol exclusion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import U64, bound_batches, flat, lowered, map_arrow, mix, pieces, release, signed, slices, word_bounds, word_hashes, written

#: Bytes of the longest context.
ORDER = 4
#: Stands before a text (as often as ORDER says) and ends it; no byte of UTF-8.
EDGE = 0xFF
SYMBOLS = 256
#: Code lengths are whole multiples of 1 / SCALE bit, so that sums don't depend on their order.
SCALE = 1 << 16
#: Full-order grams of the part of the trie that is sent out at a time. A part has at least one pair of last context bytes, so
#: at most 256 ** (ORDER - 1) grams.
PART_GRAMS = 4_000_000
#: Words with at least 1 / FREQUENT of all tokens are sent to all tasks; there are no more than FREQUENT of them.
FREQUENT = 1 << 20
#: Bytes of text that one task holds at a time when word counts are looked up; a longer document is a bucket of its own size.
BUCKET_BYTES = 8 << 20
#: Bytes of text that are counted together, and counts that a task holds before it sends them on.
SLICE_BYTES, HELD = 2 << 20, 1_000_000
_WORD, _GRAM = 0, 1
#: The token that ends a text: the hash of a byte that no word has.
END = int(signed(word_hashes(np.full(1, EDGE, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64)))[0])


def _mask(order: int) -> np.uint64:
    """The last ``order`` + 1 bytes of a gram."""
    return U64((1 << 8 * (order + 1)) - 1)


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram (ORDER bytes of context, then the symbol) of every byte and of every end, and where each text begins among them."""
    n = len(offsets) - 1
    padded = np.full(len(data) + (ORDER + 1) * n, EDGE, np.uint8)
    texts = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + ORDER * (texts + 1) + texts] = data
    wide = padded.astype(U64)
    grams = np.zeros(max(0, len(wide) - ORDER), U64)
    for j in range(ORDER + 1):
        grams = (grams << U64(8)) | wide[j : j + len(grams)]
    # the grams that end inside the padding belong to no text
    begin = offsets + np.arange(n + 1)
    at = np.arange(len(data) + n) + ORDER * np.repeat(np.arange(n), np.diff(begin))
    return grams[at], begin


# --- counting -------------------------------------------------------------------------------------


class _Sums:
    """Counts by key that grow by sorted arrays."""

    def __init__(self, kind: int):
        self.kind = kind
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        own, counts = np.unique(keys, return_counts=True)
        keys, where = np.unique(np.concatenate([self.keys, own]), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
        self.keys = keys

    def rows(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.full(len(self.keys), self.kind, np.int32)), pa.array(signed(self.keys)), pa.array(self.counts)], names=["kind", "key", "n"])
        self.__init__(self.kind)
        return out


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, key, n): words with ends, and grams, of all texts. Tasks sum their own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = _Sums(_WORD), _Sums(_GRAM)
        for batch in slices(batches, 0, SLICE_BYTES):
            data, offsets = flat(batch.column(0))
            data = lowered(data)
            starts, ends, _ = word_bounds(data, offsets)
            words.add(np.concatenate([word_hashes(data, starts, ends), np.full(batch.num_rows, END, np.int64).view(U64)]))
            grams.add(contexts(data, offsets)[0])
            yield from (s.rows() for s in (words, grams) if len(s.keys) > HELD)
        yield from (s.rows() for s in (words, grams) if len(s.keys))

    return map_arrow(docs.select(F.col(text_col).alias("text")), count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- the trie -------------------------------------------------------------------------------------


class _Lookup:
    """Values by key in an open-addressing table that is filled and asked by arrays."""

    _FREE = U64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, self._FREE, U64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == self._FREE
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], missing)
        open_ = np.flatnonzero((found != keys) & (found != self._FREE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != self._FREE)]
        return out


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass(frozen=True)
class _Level:
    """The contexts of one length and their symbols.

    whole: occurrences of a context and its escapes; escapes: number of distinct symbols. left_whole, left_escapes: the same of
    the context shorter by one byte when the symbols seen here are excluded there.
    """

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    whole: np.ndarray
    escapes: np.ndarray
    left_whole: np.ndarray
    left_escapes: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, order: int, shorter: _Level | None) -> _Level:
        own, first = np.unique(grams >> U64(8), return_index=True)
        total = np.add.reduceat(counts, first) if len(own) else np.zeros(0, np.int64)
        distinct = np.diff(np.append(first, len(grams)))
        # where every symbol was seen nothing can escape
        whole = total + np.where(distinct < SYMBOLS, distinct, 0)
        left_whole = left_escapes = np.zeros(len(own), np.int64)
        if shorter is not None and len(own):
            on = np.searchsorted(shorter.grams, grams & _mask(order - 1))
            parent = np.searchsorted(shorter.contexts, own & (_mask(order - 1) >> U64(8)))
            left_escapes = shorter.escapes[parent] - distinct
            full = shorter.escapes[parent] == SYMBOLS
            left_whole = shorter.whole[parent] - np.add.reduceat(shorter.counts[on], first) - np.where(full, 0, distinct)
        return cls(grams, counts, own, whole, distinct, left_whole, left_escapes)


class Trie:
    """The contexts whose last two bytes lie in a range, with all shorter ones.

    Escapes are estimated by method C: with t occurrences and d distinct symbols a symbol seen n times has n / (t + d), an
    escape d / (t + d). Symbols of the longer contexts that were escaped from are excluded below: counts there are full, so
    these are exactly the symbols of the context longer by one byte, whose sums each context keeps ready. Below the empty
    context all symbols not yet excluded are alike.
    """

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray], grams: np.ndarray, counts: np.ndarray, low: int = 0, high: int = 1 << 16):
        """``pairs``: order-1 grams of the whole corpus; ``grams``: sorted full-order ones whose last two context bytes are in [low, high)."""
        self.low, self.high = low, high
        sums = {0: self._summed(*pairs, 0), 1: pairs}
        for order in range(2, ORDER + 1):
            sums[order] = self._summed(grams, counts, order)
        self.levels: list[_Level] = []
        for order in range(ORDER + 1):
            self.levels.append(_Level.of(*sums[order], order, self.levels[-1] if order else None))
        top = self.levels[-1]
        self.seen = _Lookup(top.grams, self._units(top.whole[np.searchsorted(top.contexts, top.grams >> U64(8))] / np.maximum(top.counts, 1)))

    @staticmethod
    def _summed(grams: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(grams & _mask(order), return_inverse=True)
        return keys, np.bincount(where, counts, len(keys)).astype(np.int64)

    @staticmethod
    def _units(odds: np.ndarray) -> np.ndarray:
        return np.rint(np.log2(odds) * SCALE).astype(np.int32)

    def walk(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte, from the longest known context down to the one that has it."""
        bits = np.zeros(len(grams))
        open_ = np.ones(len(grams), bool)
        before = np.full(len(grams), -1)
        for order in range(ORDER, -1, -1):
            level, gram = self.levels[order], grams & _mask(order)
            context, edge = _at(level.contexts, gram >> U64(8)), _at(level.grams, gram)
            known = open_ & (context >= 0)
            longer = self.levels[order + 1] if order < ORDER else None
            first = before < 0
            whole, escapes = np.zeros((2, len(grams)), np.int64)
            new, on = known & first, known & ~first
            whole[new], escapes[new] = level.whole[context[new]], level.escapes[context[new]]
            if longer is not None:
                whole[on], escapes[on] = longer.left_whole[before[on]], longer.left_escapes[before[on]]
            hit = known & (edge >= 0)
            bits[hit] += np.log2(whole[hit] / level.counts[edge[hit]])
            # where nothing is left below an excluded context, it passes at no cost
            gone = known & ~hit & (escapes > 0)
            bits[gone] += np.log2(whole[gone] / escapes[gone])
            open_ &= ~hit
            before = np.where(known, context, before)
        left = SYMBOLS - (int(self.levels[0].escapes[0]) if len(self.levels[0].escapes) else 0)
        bits[open_] += np.log2(max(left, 1))
        return np.rint(bits * SCALE).astype(np.int32)

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Units of 1 / SCALE bit of each text with its end, as far as contexts lie in the range: whole numbers, so parts add up exactly."""
        data, offsets = flat(texts)
        grams, begin = contexts(lowered(data), offsets)
        units = self.seen.get(grams, -1)
        if self.high - self.low < 1 << 16:
            pair = (grams >> U64(8)) & U64(0xFFFF)
            units[(pair < self.low) | (pair >= self.high)] = 0
        new = np.flatnonzero(units < 0)
        if len(new):
            keys, where = np.unique(grams[new], return_inverse=True)
            units[new] = self.walk(keys)[where]
        return np.add.reduceat(units, begin[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Trained:
    """Counts in the shared folder, sums of the words, and how the trie is cut into parts (ranges of the last two context bytes)."""

    counts: DataFrame
    tokens: int
    distinct: int
    pairs: tuple[np.ndarray, np.ndarray]
    parts: list[tuple[int, int]]

    def trie(self, part: int) -> Trie:
        low, high = self.parts[part]
        own = self.counts.where((F.col("kind") == _GRAM) & _pair().between(low, high - 1)).select("key", "n").toArrow()
        grams, n = own.column(0).to_numpy().view(U64), own.column(1).to_numpy()
        order = np.argsort(grams)
        return Trie(self.pairs, grams[order], n[order], low, high)

    def words(self) -> DataFrame:
        return self.counts.where(F.col("kind") == _WORD).select(F.col("key").alias("word"), "n")

    def base(self) -> Callable[[np.ndarray | int], np.ndarray]:
        """log10 of a token's share by its count, with half a count added to every known word and to one unknown."""
        whole = math.log10(self.tokens + 0.5 * (self.distinct + 1))
        return lambda n: np.log10(np.add(n, 0.5)) - whole


def _pair() -> Column:
    return F.shiftright("key", 8).bitwiseAND(0xFFFF)


def train(docs: DataFrame, text_col: str = "text", part_grams: int | None = None) -> Trained:
    """Count the words and the byte contexts of all texts (null: empty)."""
    most = part_grams or PART_GRAMS
    counts = written(count_tokens(docs, text_col), "tokens")
    words = counts.where(F.col("kind") == _WORD).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).first()
    grams = counts.where(F.col("kind") == _GRAM)
    # at most 65,536 rows each
    pairs = grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).toArrow().sort_by("pair")
    sizes = grams.groupBy(_pair().alias("pair")).agg(F.count(F.lit(1)).alias("n")).orderBy("pair").collect()
    bounds, held = [0], 0
    for r in sizes:
        if held and held + r.n > most:
            bounds.append(r.pair)
            held = 0
        held += r.n
    parts = list(zip(bounds, [*bounds[1:], 1 << 16], strict=True))
    return Trained(counts, words.n or 0, words.distinct, (pairs.column(0).to_numpy().astype(U64), pairs.column(1).to_numpy()), parts)


# --- scores ---------------------------------------------------------------------------------------


def _units(texts: pa.ChunkedArray | pa.Array, trie: Trie) -> np.ndarray:
    """Units of each text, a MB at a time: every byte has some arrays of eight bytes."""
    bounds = flat(texts)[1]
    return np.concatenate([np.zeros(0, np.int64), *(trie.code_lengths(texts.slice(a, b - a)) for a, b in pieces(bounds))])


def _hashed(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the lower-cased texts, as signed numbers, and the first word of each text."""
    bounds = flat(texts)[1]
    words, firsts, base = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    for a, b in pieces(bounds, SLICE_BYTES):
        data, offsets = flat(texts.slice(a, b - a))
        data = lowered(data)
        starts, ends, first = word_bounds(data, offsets)
        words.append(word_hashes(data, starts, ends))
        firsts.append(first[1:] + base)
        base += len(starts)
    return signed(np.concatenate(words)), np.concatenate(firsts)


def _against(current: DataFrame, shared: Broadcast) -> DataFrame:
    """The rows with the units of one more part of the trie."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE_BYTES):
            units = batch.column("_units").to_numpy() + _units(batch.column("_text"), shared.value)
            kept = [pa.array(units) if name == "_units" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(kept, batch.schema.names)

    return map_arrow(current, step, current.schema)


def score_documents(docs: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns of ``keep``, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A-Z count as a-z throughout. Tokens are words and one end; base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over them, score
    is the trie's log10 probability of the text's bytes and its end. Null texts are empty ones; null ids and repeated rows pass
    through; other columns are not read; an empty table gives no rows. Without training every byte costs eight bits.

    Documents are dealt to buckets of bounded size. Counts of frequent words are sent to all tasks (a bounded number); a
    bucket asks for each of its other words once, whose counts come back by a join. The trie's last part scores the
    texts in the same step; parts before it (if there are any) add their units to written rows. Words are known by
    64-bit hashes (exact up to eight bytes).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    picked = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    names = [c for c in picked.columns if c != "_text"]
    blank = F.coalesce(F.col("_text"), F.lit("")) == ""
    current = picked.where(~blank).withColumn("_units", F.lit(0).cast("long"))
    nothing = 0
    for i in range(len(trained.parts)):
        trie = trained.trie(i)
        nothing += int(trie.code_lengths(pa.array([""]))[0])
        shared = spark.sparkContext.broadcast(trie)
        if i + 1 < len(trained.parts):
            current = written(_against(current, shared), "parts")
            shared.destroy()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    held = current.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(buckets)).cast("long")).groupBy("_bucket")
    words = trained.words()
    often = F.col("n") >= F.lit(trained.tokens / FREQUENT)
    frequent = words.where(often).toArrow().sort_by("word")
    known = spark.sparkContext.broadcast((frequent.column(0).to_numpy(), frequent.column(1).to_numpy()))
    end_row = words.where(F.col("word") == END).first()
    end = end_row.n if end_row else 0
    base_of = trained.base()
    results = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType())]
    out = T.StructType([*(picked.schema[n] for n in names), *(T.StructField(n, k) for n, k in results)])
    unit, tokens = math.log10(2) / SCALE, trained.tokens

    def ask(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = np.unique(_hashed(table.column("_text"))[0])
        own = own[_at(known.value[0], own) < 0]
        release()
        return pa.table([pa.array(np.full(len(own), keys[0].as_py())), pa.array(own)], names=["_bucket", "word"])

    def score(keys: tuple[pa.Scalar, ...], table: pa.Table, reply: pa.Table) -> pa.Table:
        own, firsts = _hashed(table.column("_text"))
        reply = reply.sort_by("word")
        counts = np.zeros(len(own), np.int64)
        for from_, n in (known.value, (reply.column("word").to_numpy(), reply.column("n").to_numpy())):
            at = _at(from_, own)
            counts[at >= 0] = n[at[at >= 0]]
        # sums by text; texts without words have the end alone
        some = np.flatnonzero(np.diff(firsts) > 0)
        base, n_known = np.full(table.num_rows, float(base_of(end))), np.full(table.num_rows, int(end > 0))
        if len(some):
            base[some] += np.add.reduceat(base_of(counts), firsts[some])
            n_known[some] += np.add.reduceat((counts > 0).astype(np.int64), firsts[some])
        units = table.column("_units").to_numpy() + _units(table.column("_text"), shared.value)
        n_bytes = np.diff(flat(table.column("_text"))[1])
        columns = [*(table.column(n) for n in names), pa.array(np.diff(firsts) + 1), pa.array(n_known), pa.array(np.full(len(units), tokens)), pa.array(base), pa.array(-units * unit), pa.array(units / SCALE / np.maximum(n_bytes, 1))]
        release()
        return pa.table(columns, names=out.names)

    asks = held.applyInArrow(ask, "_bucket long, word long")
    replies = asks.join(words.where(~often), "word").select("_bucket", "word", "n")
    scored = held.cogroup(replies.groupBy("_bucket")).applyInArrow(score, out)
    constant = {"n_tokens": F.lit(1).cast("long"), "n_known": F.lit(int(end > 0)).cast("long"), "train_tokens": F.lit(tokens).cast("long"), "base_score": F.lit(float(base_of(end))), "score": F.lit(-nothing * unit), "bits_per_byte": F.lit(nothing / SCALE)}
    return scored.unionByName(picked.where(blank).select(*names, *(c.alias(n) for n, c in constant.items())))
