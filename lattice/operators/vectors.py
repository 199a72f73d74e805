"""Vector search, pooling and diversity over columns of arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lattice.functions import vector as vx
from lattice.session import cut

#: Rows of one block of a group whose pairs are all compared.
PAIR_BLOCK = 512


def pair_cosines(rows: DataFrame, key: str, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, a, b, cosine) of every ordered pair of different ids of one key.

    A key is dealt to blocks by hash; two blocks are one row, which a task multiplies and hands on at once, so it holds no more than
    their pairs, however large the key. The result grows with the square of a key. Vectors of unequal length, null
    ones and those with nulls have a null cosine; the cosine of one without direction is 0.
    """
    known = rows.select(key, vec_id, embedding).where(F.col(key).isNotNull() & F.col(vec_id).isNotNull())
    sizes = known.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("_n"))
    dealt = known.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64(vec_id), F.col("_n")).cast("int"))
    blocks = dealt.groupBy(key, "_own").agg(F.collect_list(F.struct(F.col(vec_id).alias("i"), F.col(embedding).alias("v"))).alias("_rows"), F.first("_n").alias("_n"))
    left = blocks.select(key, F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_n") - 1)).alias("_j"), F.col("_rows").alias("_a"))
    right = blocks.select(key, F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"), F.col("_rows").alias("_b"))
    pairs = left.join(right, [key, "_i", "_j"]).select(key, (F.col("_i") == F.col("_j")).alias("_same"), "_a", "_b")
    kinds = [rows.schema[key].dataType, rows.schema[vec_id].dataType, rows.schema[vec_id].dataType, T.DoubleType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip((key, "a", "b", "cosine"), kinds, strict=True)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                name, same = batch.column(0).slice(r, 1), batch.column(1)[r].as_py()
                a, b = batch.column(2)[r].values, batch.column(3)[r].values
                cosines, known = _cosines(_by_length(a.field(1)), _by_length(b.field(1)), len(a), len(b))
                sides = [(a.field(0), b.field(0), cosines, known)] + ([] if same else [(b.field(0), a.field(0), cosines.T, known.T)])
                for ids, others, values, there in sides:
                    first, second = np.repeat(np.arange(len(ids)), len(others)), np.tile(np.arange(len(others)), len(ids))
                    values, there = values.ravel(), there.ravel()
                    if same:
                        # equal ids are in one block
                        codes = pc.dictionary_encode(ids).indices.to_numpy()
                        apart = codes[first] != codes[second]
                        first, second, values, there = first[apart], second[apart], values[apart], there[apart]
                    columns = [name.take(pa.array(np.zeros(len(first), np.int64))), ids.take(pa.array(first)), others.take(pa.array(second)), pa.array(values, mask=None if there.all() else ~there)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pairs.mapInArrow(multiply, schema)


def _by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, vectors, norms) of the vectors of each length; null ones and those with nulls are left out."""
    lengths = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False).copy()
    if vectors.flatten().null_count:
        lengths[[v is not None and None in v for v in vectors.to_pylist()]] = -1
    out = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        own = lengths == n
        values = vectors.filter(pa.array(own)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(own.sum(), n)
        out[n] = np.flatnonzero(own), values, np.sqrt(np.einsum("ij,ij->i", values, values))
    return out


def _cosines(a: dict, b: dict, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The cosines to six digits, halves away from zero, and where there are any."""
    out, known = np.zeros((rows, columns)), np.zeros((rows, columns), bool)
    for n in a.keys() & b.keys():
        (at, u, p), (to, v, q) = a[n], b[n]
        size = np.outer(p, q)
        cosines = np.divide(u @ v.T, size, out=np.zeros_like(size), where=~(size <= 1e-24)) * 1e6
        cosines += np.copysign(0.5, cosines)
        place = np.ix_(at, to)
        out[place], known[place] = np.trunc(cosines) / 1e6, True
    return out, known


def mean_pool(rows: DataFrame, keys: Sequence[str], embedding: str, weight: Column | None = None) -> DataFrame:
    """Mean (or weighted mean) of the vectors of each key, normalised; summed position by position, so no group is collected."""
    w = weight if weight is not None else F.lit(1.0)
    parts = rows.select(*keys, w.alias("_w"), F.posexplode(embedding).alias("_pos", "_x"))
    sums = parts.groupBy(*keys, "_pos").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    pooled = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("_v"))
    return pooled.select(*keys, vx.normalised(F.col("_v")).alias("centroid"))


def genericness(rows: DataFrame, keys: Sequence[str], row_id: str, embedding: str) -> DataFrame:
    """Mean cosine of each vector to the others of its key, divided by n with a zero diagonal: (v . sum - 1) / n in closed form."""
    unit = rows.select(*keys, row_id, vx.normalised(F.col(embedding)).alias("_u"))
    sums = unit.select(*keys, F.posexplode("_u").alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.sum("_x").alias("_s"))
    total = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_s"))), lambda s: s["_s"]).alias("_t"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return unit.join(total.join(n, list(keys)), list(keys)).select(*keys, row_id, F.round((vx.dot(F.col("_u"), F.col("_t")) - 1) / F.col("_n"), 6).alias("genericness"))


def motion(rows: DataFrame, keys: Sequence[str], order: Sequence[str], embedding: str) -> DataFrame:
    """Mean of 1 - cosine between neighbours in order; 0 for a single vector."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pairs = rows.select(*keys, *order, F.col(embedding).alias("_v"), F.lag(embedding).over(w).alias("_b"))
    step = F.when(F.col("_b").isNotNull(), 1 - vx.cosine(F.col("_v"), F.col("_b")))
    return pairs.groupBy(*keys).agg(F.round(F.coalesce(F.avg(step), F.lit(0.0)), 6).alias("motion"))


def diversity(rows: DataFrame, keys: Sequence[str], embedding: str) -> DataFrame:
    """Mean of 1 - cosine over all pairs of a key, in closed form: pairs' cosines sum to (|sum of units|^2 - n) / 2."""
    unit = rows.select(*keys, vx.normalised(F.col(embedding)).alias("_u"))
    sums = unit.select(*keys, F.posexplode("_u").alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).alias("_n"))
    g = sums.groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"), F.max("_n").alias("_n"))
    pairs = F.col("_n") * (F.col("_n") - 1)
    return g.select(*keys, F.round(F.when(pairs > 0, 1 - (F.col("_q") - F.col("_n")) / pairs).otherwise(0.0), 6).alias("diversity"))


def softmax_weight(score: Column, best: Column) -> Column:
    return F.exp(score - best)


def representatives(rows: DataFrame, key: str, row_id: str, embedding: str, k: int, importance: Column | None = None, w_generic: float = 0.3, w_similar: float = 0.5) -> DataFrame:
    """(key, row_id, position): k rows of each key, chosen one after the other by importance less genericness less the largest similarity to those chosen.

    Genericness is the mean similarity to the others of the key, in closed form; each round compares every row with the vectors
    chosen so far and takes one maximum a key, so no task holds a key. Ties go to the least id; ids are numbers without
    repeats in a key.
    """
    unit = rows.select(key, row_id, vx.normalised(F.col(embedding)).alias("_u"), (F.lit(1.0) if importance is None else importance).alias("_i"))
    sums = unit.select(key, F.posexplode("_u").alias("_pos", "_x")).groupBy(key, "_pos").agg(F.sum("_x").alias("_s"))
    total = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_s"))), lambda s: s["_s"]).alias("_t"))
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    base = cut(unit.join(total.join(n, key), key).select(key, row_id, "_u", (F.col("_i") - w_generic * (vx.dot(F.col("_u"), F.col("_t")) - 1) / F.col("_n")).alias("_base")))
    none = F.array().cast(f"array<{rows.schema[row_id].dataType.simpleString()}>")
    chosen = n.select(key, none.alias("_ids"), F.array().cast("array<array<double>>").alias("_us"))
    for _ in range(k):
        open_ = base.join(chosen, key).where(~F.array_contains("_ids", F.col(row_id)))
        nearest = F.aggregate("_us", F.lit(0.0), lambda best, v: F.greatest(best, vx.dot(F.col("_u"), v)))
        score = F.round(F.col("_base") - w_similar * nearest, 9)
        best = open_.groupBy(key).agg(F.max_by(F.struct(F.col(row_id).alias("_id"), "_u"), F.struct(score.alias("s"), (-F.col(row_id)).alias("o"))).alias("_best"))
        grown = chosen.join(best, key, "left").select(
            key,
            F.when(F.col("_best").isNull(), F.col("_ids")).otherwise(F.concat("_ids", F.array("_best._id"))).alias("_ids"),
            F.when(F.col("_best").isNull(), F.col("_us")).otherwise(F.concat("_us", F.array("_best._u"))).alias("_us"),
        )
        chosen = cut(grown)
    return chosen.select(key, F.posexplode("_ids").alias("_at", row_id)).select(key, row_id, (F.col("_at") + 1).cast("long").alias("position"))
