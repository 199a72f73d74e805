"""Texts as media columns: payloads stored as lossless WebP, read back, with features of the samples."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm import webp
from lattice.llm.common import flat, map_arrow, pieces

#: Samples of a row, and rows of an image: longer payloads are several images in one file.
WIDTH = 576
ROWS = 64
FILL = 255
#: Bytes of payload that are read together.
READ_BYTES = 4 << 20


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text filled up to a positive multiple of WIDTH bytes."""
    sizes = np.diff(offsets)
    full = np.maximum(1, -(-sizes // WIDTH)) * WIDTH
    edges = np.concatenate([[0], np.cumsum(full)])
    out = np.full(int(edges[-1]), FILL, np.uint8)
    out[np.arange(len(data)) + np.repeat(edges[:-1] - offsets[:-1], sizes)] = data
    return out, edges


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as one lossless WebP file of grey samples, WIDTH in a row.

    Up to ROWS rows are one image, more are stacked as the frames of one file, so that no image takes long to read.
    A null text counts as empty; an empty one is one row of fill. Equal texts have equal media. Repeated rows and null
    ids pass through; other columns are not read; an empty table gives no rows.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([picked.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in pieces(offsets, 4 << 20):
                samples, edges = payloads(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts = -(-np.diff(edges) // (WIDTH * ROWS))
                inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                cuts = np.append(np.repeat(edges[:-1], counts) + inner * WIDTH * ROWS, edges[-1])
                streams, heights = webp.write_grey(samples, cuts, WIDTH), (np.diff(cuts) // WIDTH).tolist()
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                media = [webp.file_of(streams[i]) if j == i + 1 else webp.stacked(streams[i:j], WIDTH, heights[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], schema.names)

    return map_arrow(picked, write, schema)


def features(stored: DataFrame, texts: bool = True) -> DataFrame:
    """Decode the stored bytes of ``store`` and describe them.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 32 bytes of the payload), media_bytes,
    media_sha256, feature (counts of samples by their upper four bits, comma-joined) and, with ``texts``, text (decoded).
    Reading goes on for some megabytes of payload at a time.
    """
    schema = T.StructType([stored.schema["doc_id"]])
    for name, kind in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("text", T.StringType()))[: 8 if texts else 7]:
        schema = schema.add(name, kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            edges = np.concatenate([[0], np.cumsum(whole.column("n_bytes").to_numpy())])
            for a, b in pieces(edges, READ_BYTES):
                batch = whole.slice(a, b - a)
                media, sizes = batch.column("media").to_pylist(), batch.column("n_bytes").to_pylist()
                planes = webp.read_grey(media)
                columns: list[list] = [[] for _ in range(7)]
                for m, n, p in zip(media, sizes, planes, strict=True):
                    payload = p.tobytes()
                    histogram = np.bincount(p >> 4, minlength=16)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), ",".join(map(str, histogram.tolist())))
                    for c, v in zip(columns, (*row, payload[:n].decode()) if texts else row, strict=False):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in list(zip(columns, kinds, strict=True))[: len(schema) - 2])], schema.names)

    return map_arrow(stored.select("doc_id", "n_bytes", "media"), read, schema)
