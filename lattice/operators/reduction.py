"""Dense vectors of texts: TF-IDF of character grams, reduced by a randomised singular value decomposition over sparse rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.operators import pruned

#: Axes that are followed beside those wanted, and rounds that sharpen them.
SPARE, ROUNDS = 10, 6
#: Columns whose sums travel together, numbers of a product that a task holds, and tasks that sum up a matrix of their own.
_COLUMNS, _NUMBERS, _TASKS = 512, 4_000_000, 64


def character_grams(text: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Every run of so many characters, in order of size."""

    def grams(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(grams, sizes))


class _Cells:
    """Sparse unit rows: (1 + ln tf) idf."""

    def __init__(self, terms: pa.Array, tfs: pa.Array, idf: np.ndarray):
        self.n = len(terms)
        self.sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        self.columns = terms.flatten().to_numpy()
        self.row = np.repeat(np.arange(self.n), self.sizes)
        self.weights = (1 + np.log(tfs.flatten().to_numpy())) * idf[self.columns]
        self.weights = self.weights / np.sqrt(np.bincount(self.row, self.weights**2, self.n))[self.row]

    def times(self, basis: np.ndarray) -> np.ndarray:
        """Rows times a dense matrix."""
        out = np.zeros((self.n, basis.shape[1]))
        some = np.flatnonzero(self.sizes)
        if len(some):
            first = (np.cumsum(self.sizes) - self.sizes)[some]
            out[some] = np.add.reduceat(basis[self.columns] * self.weights[:, None], first)
        return out

    def add_transposed(self, dense: np.ndarray, out: np.ndarray) -> None:
        """Add the transposed rows times a dense matrix to ``out``."""
        order = np.argsort(self.columns, kind="stable")
        columns = self.columns[order]
        first = np.flatnonzero(np.append(True, columns[1:] != columns[:-1])) if len(columns) else columns
        if len(first):
            out[columns[first]] += np.add.reduceat(dense[self.row[order]] * self.weights[order, None], first)


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows whose cells times ``width`` are a bounded number, or one row."""
    for batch in batches:
        cells = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64) * width)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + _NUMBERS, "right")))
            yield batch.slice(at, end - at)
            at = end


def _summed(rows: DataFrame, sent, shape: tuple[int, int], add: Callable[[_Cells, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sum over all rows of what ``add`` puts into a matrix of the shape. A task sums its own rows; chunks of the matrix are summed by many tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = sent.value
        out = np.zeros(shape)
        for batch in _slices(batches, shape[1]):
            add(_Cells(batch.column("terms"), batch.column("tfs"), idf), basis, out)
        for chunk, at in enumerate(range(0, shape[0], _COLUMNS)):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([out[at : at + _COLUMNS].tobytes()])], names=["chunk", "part"])

    def whole(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(1).to_pylist():
                own = np.frombuffer(part)
                total = own.copy() if total is None else total + own
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["chunk", "part"])

    parts = rows.select("terms", "tfs").coalesce(_TASKS).mapInArrow(partial, "chunk int, part binary").groupBy("chunk").applyInArrow(whole, "chunk int, part binary")
    out = np.zeros(shape)
    for r in parts.collect():
        own = np.frombuffer(r.part).reshape(-1, shape[1])
        out[r.chunk * _COLUMNS : r.chunk * _COLUMNS + len(own)] = own
    return out


def right_vectors(index: pruned.Index, idf: np.ndarray, dims: int, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(axes, singular values): the leading right singular vectors of the sparse rows.

    A random basis is multiplied by rows and transposed rows again and again and made orthonormal in between, which turns it
    towards the leading axes (range finder with power steps); a small eigenproblem inside it separates them. The driver holds
    matrices of the vocabulary times dims + SPARE; rows stay distributed.
    """
    size = len(index.vocabulary)
    width = min(size, dims + SPARE)
    context = index.rows.sparkSession.sparkContext
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(rounds):
        sent = context.broadcast((idf, basis))
        basis = np.linalg.qr(_summed(index.rows, sent, (size, width), lambda cells, b, out: cells.add_transposed(cells.times(b), out)))[0]
        sent.destroy()
    sent = context.broadcast((idf, basis))

    def square(cells: _Cells, b: np.ndarray, out: np.ndarray) -> None:
        y = cells.times(b)
        out += y.T @ y

    values, inner = np.linalg.eigh(_summed(index.rows, sent, (width, width), square))
    order = np.argsort(-values)[:dims]
    return basis @ inner[:, order], np.sqrt(np.maximum(values[order], 0))


def char_svd(texts: DataFrame, id_col: str, text_col: str, dims: int = 256, max_features: int = 20_000, rounds: int = ROUNDS) -> DataFrame:
    """(id, embedding): TF-IDF of the 2- to 4-grams of characters, reduced to ``dims`` axes, of length one.

    Term frequency enters as 1 + ln tf, idf as ln((1 + n) / (1 + df)) + 1; the ``max_features`` commonest grams count (ties by
    the grams' bytes). Signs of the axes are free, as in any such decomposition. Null and short texts are zero vectors; an
    empty table gives no rows.
    """
    grams = character_grams(F.col(text_col))
    common = texts.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g").limit(max_features)
    vocabulary = common.toArrow().column("g").combine_chunks()
    vocabulary = pa.concat_arrays(vocabulary.chunks) if isinstance(vocabulary, pa.ChunkedArray) else vocabulary
    index = pruned.build(texts, id_col, grams, vocabulary)
    idf = np.log((1 + index.n) / (1 + index.frequency)) + 1
    size = len(vocabulary)
    axes = right_vectors(index, idf, max(1, min(dims, index.n - 1, size - 1)), rounds)[0] if size else np.zeros((0, 1))
    sent = texts.sparkSession.sparkContext.broadcast((idf, axes))
    schema = T.StructType([T.StructField(id_col, index.rows.schema["doc_id"].dataType), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, axes = sent.value
        for batch in _slices(batches, axes.shape[1]):
            v = _Cells(batch.column("terms"), batch.column("tfs"), idf).times(axes)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, length, out=np.zeros_like(v), where=length > 0).astype(np.float32)
            bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * v.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(bounds, pa.array(v.ravel()))], names=schema.names)

    return index.rows.mapInArrow(project, schema)
