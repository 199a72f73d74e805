"""What the operators share: scratch tables in the shared folder, and words and shingles of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64
_MUL_1, _MUL_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at a time inside a batch; a longer document is one piece.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20


# --- scratch tables ---------------------------------------------------------------------------


_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary one; a cluster has to name a shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lattice-")
    _scratch.append(f"{base.rstrip('/')}/lattice-{uuid.uuid4().hex}")
    return _scratch[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this process. Call it when the results that read them are written."""
    while _scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Arrow batches -----------------------------------------------------------------------------


def bound_batches(spark: SparkSession) -> None:
    """Have Spark cut Arrow batches by bytes, not by rows alone, where the session allows larger ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back: workers are reused, and what a task leaves behind counts against the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow on batches of bounded bytes; each task gives its memory back when it ends."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose texts in ``column`` have at most ``most`` bytes together (or one longer row)."""
    for batch in batches:
        for a, b in pieces(flat(batch.column(column))[1], most or CHUNK_BYTES):
            yield batch.slice(a, b - a)


# --- words -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> U64(30))) * _MUL_1
    x = (x ^ (x >> U64(27))) * _MUL_2
    return x ^ (x >> U64(31))


_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Words up to this many bytes are hashed eight bytes at a time in arrays, longer ones one by one.
_LANES = 8
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        array = array if isinstance(array, pa.Array) else pa.concat_arrays(array.chunks)
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``most`` bytes together (or one longer document)."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (maximal runs of bytes that ``word`` has, or other than 0x20 and 0x09 to 0x0D), and the first word of each document."""
    inside = word[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A to Z in lower case."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; hashes of two seeds are independent, each read from the bytes.

    Eight bytes enter the state at a time, each time through a finaliser: words that differ in one lane leave it with
    different states. So words of up to eight bytes never collide, and longer ones only by chance.
    """
    if not len(starts):
        return np.zeros(0, U64)
    data = _LOWER[data] if lower else data
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))
    out = mix(lengths.astype(U64) * _MUL_1 + U64(seed * _BASE & 0xFFFFFFFFFFFFFFFF))
    at, left, where = starts, lengths, slice(None)
    for lane in range(_LANES):
        if lane:
            where = np.flatnonzero(lengths > 8 * lane)
            if not len(where):
                break
            at, left = starts[where] + 8 * lane, lengths[where] - 8 * lane
        value = every[at] & _KEEP[np.minimum(left, 8)]
        out[where] = mix((out[where] ^ value) * _MUL_2 + _MUL_1)
    for i in np.flatnonzero(lengths > 8 * _LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words (across documents too; the caller drops those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _MUL_2
        out += words[j : j + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
