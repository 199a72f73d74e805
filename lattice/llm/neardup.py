"""Near duplicates: many universal hash minima with banding, signature verification, exact confirmation, components."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import U64, flat, gram_hashes, map_arrow, mix, pieces, shuffle_partitions, signed, word_bounds, word_hashes, written
from lattice.llm.components import connected_components

SHINGLE = 5
#: A pair at the threshold shares no band with at most this probability.
MISSED = 1e-6
#: Most rows of a band, and most minima of a document unless bands of one row need more.
MOST_ROWS, MOST_MINIMA = 8, 640
#: Bytes of the signature, one for each of the first hash functions, that a pair is judged by before its sets are read.
SKETCH = 192
#: Rows of one side of a comparison: larger groups are compared block against block.
SKETCH_BLOCK, SET_BLOCK = 512, 128
#: Bytes of sets on one side of a comparison.
SET_BYTES = 4 << 20
#: Hash seeds: candidates are found by the first, confirmed by the second; a set is named by both.
FIND, CONFIRM = 0, 1


def banding(threshold: float) -> tuple[int, int]:
    """Number of bands and rows of each: the longest bands whose minima fit and of which a pair at the threshold shares one but for MISSED cases.

    44 bands of 8 at 0.85 and 76 bands of 8 at 0.8.
    """
    for rows in range(MOST_ROWS, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(MISSED) / math.log1p(-hit))
        if rows == 1 or bands * rows <= MOST_MINIMA:
            break
    return bands, rows


@functools.cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of n hash functions."""
    rng = np.random.default_rng(20240607)
    a = (rng.integers(1, 1 << 32, n, dtype=np.uint64) << U64(32) | rng.integers(0, 1 << 32, n, dtype=np.uint64)) | U64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def sketch_limit(threshold: float) -> int:
    """Least number of equal sketch bytes that a pair at the threshold has but for one case in millions (five deviations)."""
    return math.floor(SKETCH * threshold - 5 * math.sqrt(SKETCH * threshold * (1 - threshold)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, seed: int = FIND) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, one of none is empty."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, True, seed)
    grams = gram_hashes(words, SHINGLE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield mix(np.bitwise_xor.reduce(words[a:b] * (np.arange(b - a, dtype=U64) * U64(2) + U64(3)), keepdims=True) + U64(b - a))
        else:
            yield np.zeros(0, U64)


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of (a x + b) mod 2^64, upper half, for each of n functions."""
    a, b = _functions(n)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 512):  # blocks that stay in the cache
        part = shingles[at : at + 512]
        values = (a[:, None] * part[None, :] + b[:, None]) >> U64(32)
        np.minimum(out, values.min(1).astype(np.uint32), out=out)
    return out


def signatures(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, sketch) of (doc_id, text); set_a and set_b name the set in 128 bits."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    n_bands, n_rows = banding(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(n_bands, dtype=U64)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            sizes, set_a, set_b, bands, sketches = [], [], [], [], []
            for a, b in pieces(offsets):
                piece = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for s, again in zip(shingle_sets(*piece), shingle_sets(*piece, CONFIRM), strict=True):
                    sizes.append(len(s))
                    set_a.append(int(signed(np.add.reduce(mix(s), keepdims=True))[0]))
                    set_b.append(int(signed(np.add.reduce(mix(again), keepdims=True))[0]))
                    least = minima(s, max(n_bands * n_rows, SKETCH))
                    sketches.append(least[:SKETCH].astype(np.uint8).tobytes())
                    rows = mix(least[: n_bands * n_rows].astype(U64)).reshape(n_bands, n_rows)
                    keys = mix((rows * (np.arange(n_rows, dtype=U64) * U64(2) + U64(1))).sum(1) + mix(band))
                    bands.append(signed(keys) if len(s) else keys[:0].view(np.int64))
            counts = np.array([len(k) for k in bands], np.int32)
            edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat_bands = pa.array(np.concatenate([*bands, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), flat_bands), pa.array(sketches, pa.binary())], schema.names)

    return map_arrow(docs.select("doc_id", "text"), sign, schema)


class _Forest:
    """Union by least index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def edges(self) -> Iterator[tuple[int, int]]:
        for i in range(len(self.up)):
            if (r := self.root(i)) != i:
                yield i, r


def _in_blocks(rows: DataFrame, key: str, blocks) -> DataFrame:
    """Deal the rows of each key to units (key, low, high) of two blocks at most; a row goes to every unit of its block.

    ``blocks`` is the number of blocks of the row's key; each pair of blocks is one unit, compared by one task.
    """
    own = F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int")
    spread = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return spread.withColumn("_unit", F.xxhash64(F.col(key), low, high)).drop("_other", "_blocks")


def _by_unit(rows: DataFrame, link, schema: str = "a long, b long") -> DataFrame:
    """Run ``link`` (payloads, parts -> index pairs) on every unit, streaming over rows sorted by unit."""
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.select("_unit", "_key", "doc_id", "_part", "_payload").repartition(n, "_unit").sortWithinPartitions("_unit", "_key", "doc_id")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def linked() -> list[tuple[int, int]]:
            if len(held) < 2 or all(h[1] == held[0][1] for h in held):
                return []
            return [(held[i][0], held[j][0]) for i, j in link([h[2] for h in held], np.array([h[1] for h in held], np.int64))]

        for batch in batches:
            found: list[tuple[int, int]] = []
            units = zip(batch.column("_unit").to_pylist(), batch.column("_key").to_pylist(), strict=True)
            for unit, doc, part, payload in zip(units, batch.column("doc_id").to_pylist(), batch.column("_part").to_pylist(), batch.column("_payload").to_pylist(), strict=True):
                if unit != current:
                    found += linked()
                    held, current = [], unit
                held.append((doc, part, payload))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        found = linked()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return map_arrow(dealt, stream, schema)


def sketch_links(limit: int):
    """Rows of different parts linked by at least ``limit`` equal sketch bytes, as the edges of a spanning forest."""

    def link(payloads: list[bytes], parts: np.ndarray) -> Iterator[tuple[int, int]]:
        forest = _Forest(len(payloads))
        sketches = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), SKETCH)
        for i in range(len(payloads) - 1):
            same = np.count_nonzero(sketches[i + 1 :] == sketches[i], axis=1)
            for j in (np.flatnonzero((same >= limit) & (parts[i + 1 :] != parts[i])) + i + 1).tolist():
                forest.join(i, j)
        return forest.edges()

    return link


def set_links(num: int, den: int):
    """Rows of different parts whose sets satisfy den * intersection >= num * union, as the edges of a spanning forest. Every such pair is counted exactly."""

    def link(payloads: list[bytes], parts: np.ndarray) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(p, np.int64) for p in payloads]
        sizes = np.array([len(s) for s in sets], np.int64)
        if len(sets) == 2:
            common = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
        else:
            common = _intersections(sets, sizes)
        forest = _Forest(len(sets))
        union = sizes[:, None] + sizes[None, :] - common
        apart = parts[:, None] != parts[None, :]
        for i, j in zip(*np.nonzero(np.triu((den * common >= num * union) & apart, 1)), strict=True):
            forest.join(int(i), int(j))
        return forest.edges()

    return link


def _checked(pairs: DataFrame, payloads: DataFrame, fits) -> DataFrame:
    """The pairs (a, b) whose payloads fit. Joins by a, then by b; the many pairs of one a are a skewed join that Spark splits."""
    first = payloads.select(F.col("doc_id").alias("a"), F.col("_payload").alias("_x"))
    second = payloads.select(F.col("doc_id").alias("b"), F.col("_payload").alias("_y"))
    both = pairs.hint("merge").join(first.hint("merge"), "a").join(second.hint("merge"), "b").select("a", "b", "_x", "_y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.fromiter((fits(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)), bool, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(kept)) for i in range(2)], ["a", "b"])

    return map_arrow(both, check, "a long, b long")


def sketches_fit(limit: int):
    return lambda x, y: np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) >= limit


def sets_fit(num: int, den: int):
    def fits(x, y) -> bool:
        a, b = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
        if den * min(len(a), len(b)) < num * max(len(a), len(b)):
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return den * common >= num * (len(a) + len(b) - common)

    return fits


def _intersections(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the shingles that stand in two sets or more."""
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    column = column[where]
    out = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        matrix = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
        matrix[owner[a:b], column[a:b] - at] = 1
        out += np.rint(matrix @ matrix.T).astype(np.int64)
    return out


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, _payload): the shingle set of each text as sorted 64-bit hashes of the confirming seed; other columns pass."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("_payload", T.BinaryType())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in pieces(offsets):
                out = [s.tobytes() for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], CONFIRM)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(a, b - a) for f in others), pa.array(out, pa.binary())], schema.names)

    return map_arrow(docs.select(*(f.name for f in others), "text"), collect, schema)


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least id reachable over links), kept.

    Two documents are linked if den * |intersection| >= num * |union| of their sets of distinct 5-word shingles (A-Z
    lower-cased; a text of one to four words is one shingle; null, empty and blank texts have none and link with
    nothing). Ids are integers; rows that repeat an id have equal results, as one document whose texts all count; a
    null id links with nothing and has a null component and kept true. Other columns are not read; an empty table
    gives no rows.

    1. Every document is reduced to a signature; documents with the same set become one class, its least id stands
       for it. 2. Classes that share a band are compared with the least of them: by sketches, then on full sets. That is
       one pair for a class and band, and joins the bulk of every large group. 3. Bands whose classes are still in
       different components go on: classes of different components with similar sketches form groups, and inside each group all pairs
       of different components are confirmed on full sets, block against block. 4. Components of confirmed links give
       the classes' least ids.
    Pairs inside a component can't change it, so leaving them out loses nothing; no other pair is left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    integer = texts.schema["doc_id"].dataType
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("long"))
    limit = sketch_limit(num / den)
    signed_docs = written(signatures(texts, num / den), "signatures")
    real = signed_docs.where("n_shingles > 0 and doc_id is not null")
    of_set = ["n_shingles", "set_a", "set_b"]
    # written, so that both sides of the next join are dealt out and a hot class can be split
    classes = written(real.groupBy(of_set).agg(F.min("doc_id").alias("rep")), "reps")
    members = written(real.select("doc_id", *of_set).join(classes, of_set).select("doc_id", "rep"), "classes")

    bands = real.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", F.explode("bands").alias("_key"))
    bands = written(bands.distinct(), "bands")
    busy = written(bands.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub")).where("n > 1"), "busy")
    collided = written(bands.join(busy, "_key"), "collided")
    met = collided.select("doc_id").distinct()
    # the merge hints keep one plan at every size: texts and sketches are dealt out by id, never joined to a broadcast list.
    # An id with several texts keeps each of them here; any one that fits links its class
    sketches = written(real.select("doc_id", F.col("sketch").alias("_payload")).join(met.hint("merge"), "doc_id", "left_semi"), "sketches")
    sets = written(_sets(texts.join(met.hint("merge"), "doc_id", "left_semi")), "sets")
    pairs = collided.where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = written(_checked(pairs, sketches, sketches_fit(limit)).distinct(), "likely")
    near_hub = written(_checked(likely, sets, sets_fit(num, den)).distinct(), "near_hub")
    parts = written(connected_components(near_hub), "parts")

    placed = collided.where("n > 2").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "_key", "n", F.coalesce("component", "doc_id").alias("_part"))
    placed = written(placed, "placed")
    split = placed.groupBy("_key").agg(F.min("_part").alias("x"), F.max("_part").alias("y")).where("x < y").select("_key")
    opened = placed.join(written(split, "split"), "_key", "left_semi")
    meeting = sketches.hint("merge").join(opened.hint("merge"), "doc_id")
    candidates = _by_unit(_in_blocks(meeting, "_key", F.ceil(F.col("n") / SKETCH_BLOCK)), sketch_links(limit))
    groups = written(connected_components(candidates.distinct()), "groups").withColumnsRenamed({"node": "doc_id", "component": "_key"})

    in_group = written(sets.join(groups.hint("merge"), "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "_key", "_payload", F.coalesce("component", "doc_id").alias("_part")), "in_group")
    sizes = in_group.groupBy("_key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SET_BLOCK), F.ceil(F.sum(F.octet_length("_payload")) / SET_BYTES)).alias("n"))
    confirmed = _by_unit(_in_blocks(in_group.join(written(sizes, "sizes"), "_key"), "_key", F.col("n")), set_links(num, den))
    # texts that repeat one id link its classes too
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    repeated = members.join(several, "doc_id").where("rep > a").select("a", F.col("rep").alias("b"))
    components = written(connected_components(near_hub.unionByName(confirmed).unionByName(repeated).distinct()), "components")

    classed = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    final = classed.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = signed_docs.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(F.col("doc_id").cast(integer).alias("doc_id"), "n_shingles", component.cast(integer).alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
