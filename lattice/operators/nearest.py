"""Nearest vectors by cosine: exact products block by block, and an inverted file of trained lists with exact re-ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.operators import search
from lattice.session import scratch

#: Numbers of the queries that are sent to all tasks together, and of a product that a task holds.
QUERY_NUMBERS, PRODUCT = 4_000_000, 4_000_000
#: Vectors that one task compares with the queries of a list; longer lists are dealt to several tasks.
LIST_ROWS = 50_000
#: Vectors that train the lists, at most; steps of the training.
SAMPLE, STEPS = 50_000, 12


def matrix(column: pa.ChunkedArray | pa.Array, dims: int | None = None) -> np.ndarray:
    """The vectors as unit rows; null, empty and zero ones are rows of zeros, and so are those of another length than the first (or ``dims``)."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    lengths = pc.list_value_length(array).fill_null(0).to_numpy(zero_copy_only=False)
    dims = dims or int(next(iter(lengths[lengths > 0]), 1))
    good = lengths == dims
    out = np.zeros((len(array), dims))
    if good.any():
        out[good] = array.filter(pa.array(good)).flatten().cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, dims)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


class Best:
    """The k best vectors of each query so far, by the score to six digits, then by id."""

    def __init__(self, n: int, k: int):
        self.k, self.held = k, [[] for _ in range(n)]

    def add(self, scores: np.ndarray, ids: list) -> None:
        """``scores``: a row for each vector, a column for each query."""
        for q, own in enumerate(self.held):
            s = scores[:, q]
            if len(own) == self.k:
                rows = np.flatnonzero(s >= -own[-1][0] - 1e-6)
            elif len(s) > 4 * self.k:
                rows = np.flatnonzero(s >= np.partition(s, -self.k)[-self.k] - 1e-6)
            else:
                rows = np.arange(len(s))
            own += [(-round(float(s[r]), 6), ids[r]) for r in rows.tolist()]
            own.sort()
            del own[self.k :]

    def rows(self, ids: list) -> tuple[list, list, list]:
        flat = [(q, v, -s) for q, own in zip(ids, self.held, strict=True) for s, v in own]
        return tuple(map(list, zip(*flat, strict=True))) if flat else ([], [], [])


def _schema(vectors: DataFrame, vec_id: str, queries: DataFrame, query_id: str) -> tuple[T.StructType, pa.Schema]:
    fields = [T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(vec_id, vectors.schema[vec_id].dataType), T.StructField("score", T.DoubleType())]
    kind = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
    return T.StructType(fields), pa.schema([(f.name, kind[f.dataType]) for f in fields])


def _product_rows(n_queries: int) -> int:
    return max(64, PRODUCT // max(1, n_queries))


def exact(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """(query, vec, score, rank): the k best vectors of each query by cosine, ties by id; vectors without direction score 0.

    Queries go to all tasks in blocks of bounded size, however many there are; a task multiplies a block with its vectors and
    hands on k of them a query. Null ids are left out.
    """
    spark = vectors.sparkSession
    schema, kinds = _schema(vectors, vec_id, queries, query_id)
    asked = queries.select(query_id, embedding).where(F.col(query_id).isNotNull())
    dims = vectors.select(F.max(F.size(embedding))).first()[0] or 1
    blocks = max(1, math.ceil(asked.count() * dims / QUERY_NUMBERS))
    picked = vectors.select(vec_id, embedding).where(F.col(vec_id).isNotNull())
    out = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i).toArrow()
        sent = spark.sparkContext.broadcast((block.column(0).to_pylist(), matrix(block.column(1), dims)))
        part = picked.mapInArrow(_multiplied(sent, dims, k, kinds), schema)
        out = part if out is None else out.unionByName(part)
    return search.top_k(out, [query_id], [F.desc("score"), F.asc(vec_id)], k)


def _multiplied(sent, dims: int, k: int, kinds: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best = Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, _product_rows(len(ids))):
                part = batch.slice(at, _product_rows(len(ids)))
                best.add(matrix(part.column(1), dims) @ q.T, part.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(best.rows(ids), kinds.types, strict=True)], schema=kinds)

    return run


# --- inverted file ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class InvertedFile:
    """Unit centres of the lists, and in the shared folder every vector with its list (and the part of a long one)."""

    centres: np.ndarray
    rows: DataFrame
    parts: DataFrame
    probes: int
    recall: float


def trained_centres(sample: np.ndarray, lists: int, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """Centres by spherical k-means: unit means of the vectors nearest to them; empty ones move to the vectors that fit worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(steps):
        near = sample @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(near.max(1))[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _recall(sample: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Share of the true k best of the queries in the sample that 1, 2, ... probes would find."""
    own = (sample @ centres.T).argmax(1)
    true = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[true], 1)
    return np.cumsum(np.bincount(needed.ravel(), minlength=len(centres))) / needed.size


def build(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", lists: int | None = None, wanted: float = 0.95, k: int = 10) -> InvertedFile:
    """Train lists on at most SAMPLE vectors (those of the least hashes), deal every vector to its nearest list, and find how many lists a search has to probe.

    ``lists``: the square root of the number of vectors unless given. Probes are the fewest that reach ``wanted`` recall of the k
    best on 200 of the sample's own vectors; ``recall`` says what they reach there. Vectors of null id are left out.
    """
    spark = vectors.sparkSession
    picked = vectors.select(vec_id, embedding).where(F.col(vec_id).isNotNull())
    n, dims = picked.agg(F.count(F.lit(1)), F.max(F.size(embedding))).first()
    share = 1.2 * SAMPLE / max(n, 1)
    chosen = picked if share >= 1 else picked.where(F.pmod(F.xxhash64(vec_id), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = matrix(chosen.orderBy(F.xxhash64(vec_id)).limit(SAMPLE).select(embedding).toArrow().column(0), dims or 1)
    sample = sample[np.any(sample != 0, axis=1)] if len(sample) else sample
    if not len(sample):
        sample = np.eye(1, dims or 1)
    centres = trained_centres(sample, lists or max(1, round(math.sqrt(n))))
    reached = _recall(sample, sample[:200], centres, min(k, len(sample)))
    probes = int(np.argmax(reached >= wanted)) + 1 if (reached >= wanted).any() else len(centres)
    sent = spark.sparkContext.broadcast(centres)
    schema = T.StructType([*picked.schema.fields, T.StructField("_list", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = _product_rows(len(sent.value))
            own = [(matrix(batch.column(1).slice(a, step), sent.value.shape[1]) @ sent.value.T).argmax(1) for a in range(0, batch.num_rows, step)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int32))], names=schema.names)

    path = scratch(spark, "lists")
    picked.mapInArrow(assign, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    parts = rows.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("_parts"))
    return InvertedFile(centres, rows, parts, probes, float(reached[probes - 1]))


def probe(index: InvertedFile, queries: DataFrame, k: int, vec_id: str = "vec_id", query_id: str = "query_id", embedding: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query, vec, score, rank) of the k best vectors in the lists nearest to each query, by exact cosine, ties by id.

    Queries and vectors meet by list; a list longer than LIST_ROWS is dealt to several tasks, to each of which its queries go.
    """
    spark = queries.sparkSession
    schema, kinds = _schema(index.rows, vec_id, queries, query_id)
    sent, most = spark.sparkContext.broadcast(index.centres), min(probes or index.probes, len(index.centres))
    asked = queries.select(query_id, embedding).where(F.col(query_id).isNotNull())
    wanted = T.StructType([*asked.schema.fields, T.StructField("_list", T.ArrayType(T.IntegerType()))])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(matrix(batch.column(1), sent.value.shape[1]) @ sent.value.T), axis=1, kind="stable")[:, :most]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=wanted.names)

    sides = asked.mapInArrow(choose, wanted).withColumn("_list", F.explode("_list")).join(index.parts, "_list").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    dealt = index.rows.join(index.parts, "_list").withColumn("_part", F.pmod(F.xxhash64(vec_id), F.col("_parts")).cast("int")).drop("_parts")
    dims = index.centres.shape[1]

    def rank(table: pa.Table, q: pa.Table) -> pa.Table:
        ids, unit = q.column(query_id).to_pylist(), matrix(q.column(embedding), dims)
        best = Best(len(ids), k)
        step = _product_rows(len(ids))
        for at in range(0, table.num_rows if ids else 0, step):
            part = table.slice(at, step)
            best.add(matrix(part.column(embedding), dims) @ unit.T, part.column(vec_id).to_pylist())
        return pa.table([pa.array(c, t) for c, t in zip(best.rows(ids), kinds.types, strict=True)], schema=kinds)

    keys = ("_list", "_part")
    found = dealt.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(rank, schema)
    return search.top_k(found, [query_id], [F.desc("score"), F.asc(vec_id)], k)
