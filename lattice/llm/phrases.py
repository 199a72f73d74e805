"""Collocations: phrases whose words stand together more often than alone, counted level by level behind hash buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.llm.common import U64, flat, gram_hashes, lowered, map_arrow, mix, slices, word_bounds, word_hashes, written

#: Language of rows without one.
UNDETERMINED = "und"
#: Occurrences that make a phrase frequent.
LEAST = 30
#: Words of the longest phrase.
LONGEST = 4
#: Phrases of each language that are returned.
TOP = 2000
#: Hash buckets of a level, as a power of two: their bitmap is 8 MB, whatever the corpus. More keep pruning sharp on larger ones.
BUCKET_BITS = 26
#: Buckets whose counts travel together.
_CHUNK_BITS = 16
#: Bytes of text that are split into words together, and distinct phrases that a task holds before it sends them on.
SLICE_BYTES, HELD = 4 << 20, 1_000_000
#: Parts in which the phrases of a language are ranked first.
SALTS = 64

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORDS = ~_BREAKS
_WORDS[[0x20, 0x09]] = False

_ROWS = "lang string, phrase string, hash long, n long, chunk int, at binary, counts binary"


# --- words of a batch ----------------------------------------------------------------------------


class _Words:
    """Words of the texts of a batch, which of them are followed by another word of their piece, and hashes of their grams."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = flat(texts)
        self.data = lowered(data)
        self.starts, self.ends, firsts = word_bounds(self.data, offsets, _WORDS)
        doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
        piece = np.cumsum(_BREAKS[self.data], dtype=np.int32)[self.starts]
        self.joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        coded = langs.dictionary_encode()
        self.names, self.lang = coded.dictionary, coded.indices.to_numpy()[doc]
        salts = np.array([xxhash.xxh3_64_intdigest(name) for name in self.names.to_pylist()], U64)
        self.salt = salts[self.lang] if len(doc) else np.zeros(0, U64)
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def grams(self, k: int) -> np.ndarray:
        """Hash of language and words of every run of k words, those across pieces too."""
        out = gram_hashes(self.hashes, k)
        return mix(out ^ self.salt[: len(out)])

    def whole(self, k: int) -> np.ndarray:
        """Which runs of k words lie in one piece."""
        n = max(0, len(self.starts) - k + 1)
        out = np.ones(n, bool)
        for j in range(k - 1):
            out &= self.joined[j : j + n]
        return out

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each place on, joined by one space."""
        begin, end = self.starts[at[:, None] + np.arange(k)].ravel(), self.ends[at[:, None] + np.arange(k)].ravel()
        sizes = end - begin
        to = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + 1, out=to[1:])
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # the space after the last word of a phrase is left out: every k-th word moves the rest by one
        to = to[:-1] - np.arange(len(sizes)) // k
        out = np.full(int(sizes.sum()) + len(at) * (k - 1), 32, np.uint8)
        out[np.repeat(to, sizes) + step] = self.data[np.repeat(begin, sizes) + step]
        bounds = np.append(to[::k], len(out)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(out)])


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes' buckets are set."""
    bucket = _bucket(hashes, len(bits) * 8)
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> U64(64 - buckets.bit_length() + 1)).astype(np.int64)


def _bucket_rows(buckets: np.ndarray, counts: np.ndarray, least: int) -> pa.RecordBatch:
    """A row for each chunk of sorted buckets that has any: their places in it, and their counts, which stop at ``least``."""
    chunk = buckets >> _CHUNK_BITS
    first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
    bounds = np.append(first, len(buckets)).astype(np.int64)
    at = (buckets & ((1 << _CHUNK_BITS) - 1)).astype(np.uint16)
    capped = np.minimum(counts, least).astype(_kind(least))

    def binary(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds * values.itemsize), pa.py_buffer(values)]).cast(pa.binary())

    none = [pa.nulls(len(first), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([*none, pa.array(chunk[first].astype(np.int32)), binary(at), binary(capped)], names=["lang", "phrase", "hash", "n", "chunk", "at", "counts"])


def _kind(least: int) -> type:
    """The type of a count that stops at ``least``."""
    return np.uint8 if least < 256 else np.uint32


# --- passes --------------------------------------------------------------------------------------


class _Held:
    """Distinct phrases of a task with their counts, by hash."""

    def __init__(self, k: int):
        self.k = k
        self.clear()

    def clear(self) -> None:
        self.hashes, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.langs, self.phrases = pa.array([], pa.string()), pa.array([], pa.large_string())

    def add(self, words: _Words, at: np.ndarray, hashes: np.ndarray) -> None:
        own, where, counts = np.unique(hashes, return_index=True, return_counts=True)
        known = np.isin(own, self.hashes, assume_unique=True)
        self.counts[np.searchsorted(self.hashes, own[known])] += counts[known]
        new = at[where[~known]]
        order = np.argsort(np.concatenate([self.hashes, own[~known]]), kind="stable")
        self.hashes = np.concatenate([self.hashes, own[~known]])[order]
        self.counts = np.concatenate([self.counts, counts[~known]])[order]
        self.phrases = pa.concat_arrays([self.phrases, words.phrases(new, self.k)]).take(pa.array(order))
        self.langs = pa.concat_arrays([self.langs, words.names.take(pa.array(words.lang[new]))]).take(pa.array(order))

    def rows(self) -> pa.RecordBatch:
        n = len(self.hashes)
        columns = [self.langs, self.phrases.cast(pa.string()), pa.array(self.hashes.view(np.int64)), pa.array(self.counts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        out = pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "hash", "n", "chunk", "at", "counts"])
        self.clear()
        return out


def _counted(docs: DataFrame, k: int, least: int, last: bool, filters: tuple | None) -> DataFrame:
    """One pass over the texts: counts of the candidates of k words, and bucket counts of the runs of k + 1 words that may become candidates.

    A run of k words is a candidate if its bucket was full in the pass before and both its runs of k - 1 words are frequent.
    """
    buckets = 1 << BUCKET_BITS

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(k)
        for batch in slices(batches, "text", SLICE_BYTES):
            words = _Words(batch.column("text"), batch.column("lang"))
            hashes, chosen = words.grams(k), words.whole(k)
            if filters is not None:
                shorter, full = (f.value for f in filters)
                known = _set(shorter, words.grams(k - 1)) & words.whole(k - 1)
                chosen &= known[: len(chosen)] & known[1 : 1 + len(chosen)]
                where = np.flatnonzero(chosen)
                chosen[where] = _set(full, hashes[where])
            at = np.flatnonzero(chosen)
            held.add(words, at, hashes[at])
            if not last:
                longer = words.whole(k + 1)
                longer &= chosen[: len(longer)] & chosen[1 : 1 + len(longer)]
                found, counts = np.unique(_bucket(words.grams(k + 1)[longer], buckets), return_counts=True)
                yield _bucket_rows(found, counts, least)
            if len(held.hashes) > HELD:
                yield held.rows()
        if len(held.hashes):
            yield held.rows()

    return map_arrow(docs, step, _ROWS)


def _bits(rows: DataFrame, least: int) -> np.ndarray:
    """The bitmap of the buckets whose counts reach ``least``. Counts are summed chunk by chunk where the chunks are dealt to; the driver gets the bits."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(least)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.get(chunk)
                if own is None:
                    own = sums[chunk] = np.zeros(1 << _CHUNK_BITS, kind)
                places = np.frombuffer(at, np.uint16)
                # neither passes least, so their sum fits twice that
                own[places] = np.minimum(own[places].astype(np.uint64) + np.frombuffer(counts, kind), least)
        for chunk, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(own >= least, bitorder="little").tobytes()])], names=["chunk", "bits"])

    out = np.zeros((1 << BUCKET_BITS) // 8, np.uint8)
    size = (1 << _CHUNK_BITS) // 8
    dealt = rows.where("chunk is not null").select("chunk", "at", "counts").repartition("chunk")
    for r in map_arrow(dealt, step, "chunk int, bits binary").toLocalIterator(prefetchPartitions=True):
        part = np.frombuffer(r.bits, np.uint8)
        out[r.chunk * size : r.chunk * size + len(part)] = part[: len(out)]
    return out


def _frequent_bits(frequent: DataFrame) -> np.ndarray:
    """The bitmap of the buckets of frequent phrases."""
    buckets = 1 << BUCKET_BITS

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.unique(_bucket(batch.column(0).to_numpy().view(U64), buckets))
            yield _bucket_rows(own, np.ones(len(own), np.int64), 1)

    return _bits(map_arrow(frequent.select("hash"), step, _ROWS), 1)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, hash, n) of the phrases of 1, 2, ... words with n >= least, and (lang, n) with all words of each language.

    Each pass counts its candidates exactly and hashes the runs of one more word into buckets. Buckets with fewer than
    ``least`` runs hold no frequent one; the bitmap of the others goes to the next pass with that of the frequent phrases
    (both have a fixed size). Bits of other phrases in the same bucket only let more candidates through to the exact count.
    """
    picked = docs.select(F.coalesce(F.col(lang_col), F.lit(UNDETERMINED)).alias("lang"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    tables, totals, filters = [], None, None
    for k in range(1, longest + 1):
        rows = written(_counted(picked, k, least, k == longest, filters), f"pass{k}")
        for shared in filters or ():
            shared.destroy()
        counts = rows.where("chunk is null").groupBy("lang", "phrase").agg(F.max("hash").alias("hash"), F.sum("n").alias("n"))
        if k == 1:
            totals = rows.where("chunk is null").groupBy("lang").agg(F.sum("n").alias("n"))
        tables.append(written(counts.where(F.col("n") >= least), f"frequent{k}"))
        if k < longest:
            filters = context.broadcast(_frequent_bits(tables[-1])), context.broadcast(_bits(rows, least))
    return tables, totals


# --- scores --------------------------------------------------------------------------------------


def _long(column: str) -> F.Column:
    return F.col(column).cast("decimal(38,0)")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are split into pieces at .,;:!? and 0x0A to 0x0D, pieces into words at blanks and tabs; A-Z count as a-z. a counts the
    phrase, l and r the two parts of its lowest-scoring cut (ties: the first), n all words of the language; score is
    floor(2000000 a / (l + r)). Phrases inside a longer frequent one that has 80 % of their occurrences are dropped. Ordered by
    score, a (both falling) and the phrase's bytes. A null language counts as ``und``; null and empty texts have no words;
    repeated rows count each time; other columns are not read; an empty table gives no rows.

    Inside a task phrases are told apart by 64-bit hashes, between tasks by their words.
    """
    tables, totals = frequent_phrases(docs, lang_col, text_col, least, longest)
    empty = tables[0].limit(0)
    known = empty
    for t in tables[:-1]:
        known = known.unionAll(t)
    found = empty
    for t in tables[1:]:
        found = found.unionAll(t)
    found = found.select("lang", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    size = F.size("words")
    cuts = found.withColumn("words", words).select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("words", F.col("cut") + 1, size), " ").alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    # div on decimals is exact; their quotient would be rounded
    scored = scored.select("lang", "phrase", F.struct(F.expr("(2000000 * cast(a AS decimal(30,0))) div (cast(l AS decimal(38,0)) + r)").alias("score"), "cut", "l", "r", "a").alias("at"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min("at").alias("at")).select("lang", "phrase", "at.*")
    # what lies inside longer phrases, with the most frequent of these
    runs = F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))))"))
    inside = found.withColumn("words", words).where(size > 2).select("lang", runs.alias("phrase"), "a")
    covers = inside.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    kept = lowest.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * _long("cover") < 80 * _long("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each part of a language keeps its best, so the last ranking has a bounded number of rows
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
