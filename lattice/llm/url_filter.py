"""URL filter: a sorted array of 64-bit xxhash keys, memory-mapped, probed by binary search and confirmed on stored strings."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import map_arrow, scratch_dir, slices, written

#: A digest array up to this size goes to every executor; a larger list is dealt to shards of the array by key.
MAX_BROADCAST_BYTES = 64 << 20
#: Seed of the keys, that of Spark's own xxhash64.
SEED = 42
#: Probes that one group of a shard gets.
PROBES = 1_000_000


def _digest(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, SEED)


class DigestArray:
    """Sorted xxhash64 keys with the strings they stand for.

    Layout of the file: number of entries, keys (sorted), string offsets, UTF-8 of the strings in key order.
    Equal keys of different strings (collisions) stand side by side; a probe compares every one of them.
    """

    def __init__(self, buffer: np.ndarray):
        n = int(buffer[:8].view(np.uint64)[0])
        self.keys = buffer[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = buffer[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.strings = buffer[16 + 16 * n :]

    @staticmethod
    def pack(entries: Sequence[str], key=_digest) -> bytes:
        raw = sorted((key(e), e) for e in {x.encode() for x in entries})
        offsets = np.zeros(len(raw) + 1, np.uint64)
        offsets[1:] = np.cumsum([len(e) for _, e in raw], dtype=np.uint64)
        keys = np.array([k for k, _ in raw], np.uint64)
        return np.array([len(raw)], np.uint64).tobytes() + keys.tobytes() + offsets.tobytes() + b"".join(e for _, e in raw)

    @classmethod
    def mapped(cls, name: str) -> DigestArray:
        """Memory-map the file that Spark has sent to this executor; its workers share the pages."""
        return cls(np.memmap(SparkFiles.get(name), np.uint8, "r"))

    def contains(self, values: Sequence[str], key=_digest) -> np.ndarray:
        """One boolean per value: binary search over all keys at once, then the strings of equal keys alone."""
        raw = [v.encode() for v in values]
        wanted = np.fromiter((key(v) for v in raw), np.uint64, len(raw))
        out = np.zeros(len(raw), bool)
        if not len(self.keys):
            return out
        at = np.searchsorted(self.keys, wanted)
        live = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)
        while len(live):  # one turn, and one more for each further string of an equal key
            k = at[live].tolist()
            same = np.fromiter((self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == raw[i] for i, j in zip(live.tolist(), k, strict=True)), bool, len(live))
            out[live[same]] = True
            live = live[~same]
            at[live] += 1
            live = live[(at[live] < len(self.keys))]
            live = live[self.keys[at[live]] == wanted[live]]
        return out


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both empty where the url is null or has no ``://``."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    rest = F.when(F.contains(F.col(url), F.lit("://")), rest).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumns({"host": F.coalesce(F.translate(host, upper, lower), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_column(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path"):
    """The longest fitting rule as a struct (rule, verdict), else null. ``rules``: (verdict, host/path...).

    A rule fits its host and every subdomain if the path starts with the rule's path.
    """
    longest_first = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = None
    for verdict, rule in longest_first:
        rule_host, slash, rest = rule.partition("/")
        fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(slash + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    empty = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return empty if out is None else out.otherwise(empty)


def candidates(host: str, path: str) -> list[str]:
    """What a list may hold about a url: the host, its parent domains, and the host with its path."""
    if not host:
        return []
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] + [host + path]


def listed_mapped(df: DataFrame, content: bytes) -> DataFrame:
    """Add ``listed`` by the digest array: a file that Spark sends to every executor once (its size is bounded by the caller)."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    name = f"digests-{folder.rsplit('-', 1)[-1]}.bin"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    file = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    file.write(bytearray(content))
    file.close()
    spark.sparkContext.addFile(f"{folder}/{name}")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = DigestArray.mapped(name)
        for batch in slices(batches, "path"):
            hosts = batch.column("host").to_pylist()
            paths = batch.column("path").to_pylist()
            many = [candidates(h, p) for h, p in zip(hosts, paths, strict=True)]
            hits = digests.contains([c for m in many for c in m])
            ends = np.cumsum([len(m) for m in many], dtype=np.int64)
            totals = np.concatenate([[0], np.cumsum(hits)])
            counts = totals[ends] - totals[ends - np.array([len(m) for m in many], np.int64)] if many else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts > 0, pa.bool_())], [*batch.schema.names, "listed"])

    schema = T.StructType([*df.schema.fields, T.StructField("listed", T.BooleanType())])
    return map_arrow(df, probe, schema)


def listed_sharded(df: DataFrame, entries: DataFrame, size: int, most: int) -> DataFrame:
    """Add ``listed`` where the array is too large to send around: it is dealt to shards by key, and every shard is a sorted array of
    its own that is probed in the same way. Probes are distinct, and those of a shard are spread over as many groups as they need.
    """
    hosts = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(hosts)), lambda i: F.array_join(F.slice(hosts, i, F.size(hosts)), "."))
    wanted = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, F.array(F.concat("host", "path"))))
    urls = written(df.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(wanted)).alias("entry")), "probes")
    shards = max(1, math.ceil(size / max(most, 1 << 20)))
    shard = F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("long")
    probes = urls.select("entry").distinct()
    spread = max(1, math.ceil(urls.count() / (shards * PROBES)))
    keys = entries.select("entry").where(F.col("entry").isNotNull()).distinct().select("entry", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    asked = probes.select("entry", shard.alias("shard"), F.pmod(F.hash("entry"), F.lit(spread)).alias("part"))

    def probe(stored: pa.Table, sought: pa.Table) -> pa.Table:
        digests = DigestArray(np.frombuffer(DigestArray.pack(stored.column("entry").to_pylist()), np.uint8))
        values = sought.column("entry")
        return pa.table([values.filter(pa.array(digests.contains(values.to_pylist())))], names=["entry"])

    found = keys.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(probe, "entry string")
    hits = urls.join(found, "entry", "left_semi").select("host", "path").distinct().withColumn("listed", F.lit(True))
    return df.join(hits, ["host", "path"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def url_filter(
    pages: DataFrame,
    blocked: DataFrame | Sequence[str],
    rules: Sequence[tuple[str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Judge every url. Returns (id, host, path, rule, listed, verdict), one row per row of ``pages``.

    The longest fitting rule decides; without one, a url is blocked if its host, a parent domain, or host and
    path together stand in ``blocked`` (a sequence of strings, or a table with a column ``entry``).
    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed. Repeated rows and
    null ids pass through; other columns of ``pages`` are not read. An empty table or list gives an empty result
    or no listed url.
    """
    spark: SparkSession = pages.sparkSession
    base = split_url(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url").select("page_id", "host", "path")
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(b,) for b in blocked], "entry string")
    size = blocked.agg(F.sum(F.octet_length("entry") + 16)).first()[0] or 0
    if size > max_broadcast_bytes:
        listed = listed_sharded(base, written(blocked.select("entry"), "blocked"), size, max_broadcast_bytes)
    else:
        listed = listed_mapped(base, DigestArray.pack([r.entry for r in blocked.select("entry").where("entry is not null").distinct().collect()]))
    judged = listed.withColumn("_rule", rule_column(rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("page_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), "listed", verdict.alias("verdict"))
