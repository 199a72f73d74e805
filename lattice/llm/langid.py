"""Language identification by prediction by partial matching: byte context trees of order 3 with frozen counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import flat, map_arrow, pieces, slices, written

UNDETERMINED = "und"
ORDER = 3
#: Languages that may be learned.
MAX_LANGUAGES = 4096
#: Four-grams of the part of the model that is sent out at a time (or those of one language, if it alone has more).
SHARD_GRAMS = 1_600_000
#: Code lengths are whole multiples of 1 / SCALE bit, so that sums don't depend on their order.
SCALE = 1 << 16
#: Byte pairs with a row and a column of their own in the table of ready code lengths.
READY_PAIRS = 600


def _grams(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Four-grams (three bytes of context, then the byte) of every byte of the lower-cased texts, and where each text begins.

    Three line feeds stand before each text.
    """
    data, offsets = flat(pc.utf8_lower(array))
    n = len(offsets) - 1
    padded = np.full(len(data) + ORDER * n, 10, np.uint8)
    lengths = np.diff(offsets)
    at = np.arange(len(data)) + ORDER * (np.repeat(np.arange(n), lengths) + 1)
    padded[at] = data
    wide = padded.astype(np.uint32)
    if not len(data):
        return np.zeros(0, np.uint32), offsets
    every = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    return every[at - ORDER], offsets


def count_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows with a language and a text: each task sums its own, one aggregation sums the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            langs = pa.array([lang for lang, (k, _) in totals.items() for _ in range(len(k))], pa.string())
            keys = np.concatenate([k for k, _ in totals.values()]).astype(np.int64)
            counts = np.concatenate([c for _, c in totals.values()])
            totals.clear()
            return pa.RecordBatch.from_arrays([langs, pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
                _, offsets = flat(texts)
                for a, b in pieces(offsets):
                    keys, counts = np.unique(_grams(texts.slice(a, b - a))[0], return_counts=True)
                    if lang in totals:
                        keys = np.concatenate([totals[lang][0], keys])
                        counts = np.concatenate([totals[lang][1], counts])
                        keys, where = np.unique(keys, return_inverse=True)
                        counts = np.bincount(where, counts, len(keys)).astype(np.int64)
                    totals[lang] = keys, counts.astype(np.int64)
            if sum(len(k) for k, _ in totals.values()) > 1_000_000:
                yield flush()
        if totals:
            yield flush()

    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return map_arrow(labelled, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class _Tree:
    """Counts of one language by order, as sorted keys; contexts carry their total and their number of distinct bytes."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> _Tree:
        grams, sums, contexts, totals, distinct = [], [], [], [], []
        for order in range(ORDER + 1):
            k, where = np.unique(keys & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(where, counts, len(k))
            c, where, q = np.unique(k >> np.uint32(8), return_inverse=True, return_counts=True)
            grams.append(k)
            sums.append(n)
            contexts.append(c)
            totals.append(np.bincount(where, n, len(c)))
            distinct.append(q.astype(float))
        return cls(grams, sums, contexts, totals, distinct)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each key's last byte after the bytes before it, in units of 1 / SCALE bit.

        Method C: a seen byte costs n / (total + distinct), an escape distinct / (total + distinct), then the next shorter
        context codes the byte; below order 0 all 256 bytes are alike. A context never seen passes at no cost.
        """
        p = np.full(len(keys), 1 / 256)
        for order in range(ORDER + 1):
            gram = keys & np.uint32((1 << 8 * (order + 1)) - 1)
            context = gram >> np.uint32(8)
            at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            known = self.contexts[order][at] == context
            whole = self.totals[order][at] + self.distinct[order][at]
            on = np.minimum(np.searchsorted(self.grams[order], gram), len(self.grams[order]) - 1)
            seen = self.grams[order][on] == gram
            longer = np.where(seen, self.counts[order][on], self.distinct[order][at] * p) / whole
            p = np.where(known, longer, p)
        return np.rint(-np.log2(p) * SCALE).astype(np.int32)


class Model:
    """Context trees of all languages, and a table of ready code lengths for common pairs of byte pairs."""

    def __init__(self, languages: list[str], trees: list[_Tree]):
        self.languages, self.trees = languages, trees
        weight = np.zeros(65536)
        for tree in trees:
            np.add.at(weight, tree.grams[1], tree.counts[1] / max(tree.counts[1].sum(), 1))
        common = np.sort(np.argsort(-weight, kind="stable")[: min(READY_PAIRS, int((weight > 0).sum()))]).astype(np.uint32)
        self.pair = np.full(65536, -1, np.int32)
        self.pair[common] = np.arange(len(common))
        self.width = len(common)
        keys = ((common[:, None] << np.uint32(16)) | common[None, :]).ravel()
        self.ready = self.bits(keys)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(keys) for t in self.trees], 1) if self.trees else np.zeros((len(keys), 0), np.int32)

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """A row for each text, a column for each language: exact sums in units of 1 / SCALE bit."""
        _, bounds = flat(texts)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for a, b in pieces(bounds):
            grams, offsets = _grams(texts.slice(a, b - a))
            # a document beyond the piece size is summed in parts
            for begin in range(0, len(grams), 1 << 20):
                part = grams[begin : begin + (1 << 20)]
                x, y = self.pair[part >> np.uint32(16)], self.pair[part & np.uint32(0xFFFF)]
                rows = self.ready[np.where((x < 0) | (y < 0), 0, x * self.width + y)]
                slow = np.flatnonzero((x < 0) | (y < 0))
                if len(slow):
                    keys, where = np.unique(part[slow], return_inverse=True)
                    rows[slow] = self.bits(keys)[where]
                edges = np.clip(offsets - begin, 0, len(part))
                docs = np.flatnonzero(np.diff(edges) > 0)
                if len(docs):
                    out[a + docs] += np.add.reduceat(rows, edges[docs], 0, np.int64)
        return out


@dataclass(frozen=True)
class Counts:
    """Every counted four-gram, in the shared folder, and the languages of each part of the model."""

    grams: DataFrame
    shards: list[list[str]]

    def model(self, languages: list[str]) -> Model:
        """The trees of some languages, each collected on its own."""
        trees = []
        for lang in languages:
            own = self.grams.where(F.col("lang") == lang).select("gram", "n").toPandas()
            trees.append(_Tree.of(own.gram.to_numpy().astype(np.uint32), own.n.to_numpy()))
        return Model(languages, trees)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_grams: int = SHARD_GRAMS) -> Counts:
    """Count every labelled row. All grams stay; languages are put together to parts of at most ``shard_grams`` grams.

    A language has as many grams as its letters make, which levels off with the corpus; more languages make more parts,
    and each part is sent out and released on its own. More than MAX_LANGUAGES labels are an error.
    """
    counts = written(count_grams(docs, lang_col, text_col), "grams")
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shards: list[list[str]] = []
    held = shard_grams
    for lang in sorted(sizes):
        if held + sizes[lang] > shard_grams:
            shards.append([])
            held = 0
        shards[-1].append(lang)
        held += sizes[lang]
    return Counts(counts, shards)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold`` (null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, model: Counts, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns of ``keep``, lang_pred, score, bits_per_byte.

    The language with the shortest code (the first by name on ties); score is its posterior under equal priors. ``und`` with
    score 0 where the text is null or has no letter, or where nothing was learned. Whole texts of any length count.
    Only the named columns are read; repeated rows and null ids pass through; an empty table gives no rows.

    Every part of the model sees every text: the best language so far, its units and the sum of all posterior weights
    relative to it go on from part to part, so the result doesn't depend on how languages are put together.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    names = [c for c in chosen.columns if c != "_text"]
    current = chosen.select(*names, "_text", F.lit(None).cast("string").alias("_best"), F.lit(0).cast("long").alias("_units"), F.lit(0.0).alias("_weight"))
    for i, languages in enumerate(model.shards):
        current = _against(current, model.model(languages))
        if i + 1 < len(model.shards):
            current = written(current, "parts")
    known = F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False)) & F.col("_best").isNotNull()
    size = F.greatest(F.octet_length("_text"), F.lit(1))
    return current.select(
        *names,
        F.when(known, F.col("_best")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, 1 / F.col("_weight")).otherwise(0.0).alias("score"),
        F.when(known, F.col("_units") / SCALE / size).otherwise(0.0).alias("bits_per_byte"),
    )


def _against(current: DataFrame, model: Model) -> DataFrame:
    """The running best over one more part of the model."""
    shared = current.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        nats = np.log(2) / SCALE
        for batch in slices(batches, "_text"):
            units = m.code_lengths(batch.column("_text"))
            best = units.argmin(1)
            least = units[np.arange(len(units)), best]
            weight = np.exp((least[:, None] - units) * nats).sum(1)
            before = batch.column("_best").to_pylist()
            has = np.array([b is not None for b in before])
            old, old_weight = batch.column("_units").to_numpy(), batch.column("_weight").to_numpy()
            # parts come in order of language, so the earlier one wins a tie
            better = ~has | (least < old)
            new = np.where(better, least, old)
            total = weight * np.exp((new - least) * nats) + np.where(has, old_weight * np.exp(np.where(has, new - old, 0) * nats), 0.0)
            label = [m.languages[k] if b else was for k, b, was in zip(best, better, before, strict=True)]
            kept = [batch.column(c) for c in batch.schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(label, pa.string()), pa.array(new, pa.int64()), pa.array(total)], batch.schema.names)

    return map_arrow(current, predict, current.schema)
