"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm.common import bound_batches

#: Copies of a document that one array numbers.
COPY_BLOCK = 1_000_000
#: Sources that are not named share one weight under this name.
OTHER = "*"
#: The largest number of sources that may be named: it bounds the rate table.
MAX_NAMED = 10_000
#: Digits of MD5 that make the uniform number.
_DIGITS = 13


#: Terms of the distribution that are summed at a time.
_TERMS = 1024


def _poisson_terms(rate: float, k: np.ndarray) -> np.ndarray:
    """P(count = k) by its deviation from the rate, so that large rates keep their precision."""
    x = np.maximum(k, 1.0)
    d = (x - rate) / rate
    near = np.abs(d) < 1e-3
    small = np.where(near, d, 0.0)
    deviance = np.where(near, small * small * (1 / 2 - small * (1 / 6 - small * (1 / 12 - small * (1 / 20 - small / 30)))), (1 + d) * np.log1p(np.where(near, 0.0, d)) - d)
    # log k! less its leading terms
    rest = np.where(x < 16, np.array([math.lgamma(i + 1) - (i + 0.5) * math.log(max(i, 1)) + i - 0.5 * math.log(2 * math.pi) for i in range(16)])[np.minimum(x, 15).astype(int)], 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7))
    return np.where(k == 0, math.exp(-rate), np.exp(-rate * deviance - rest) / np.sqrt(2 * math.pi * x))


def poisson_quantiles(rate: float, u: np.ndarray) -> np.ndarray:
    """The number of k with P(count <= k) <= u, for each u: the distribution inverted by walking up from its lower tail.

    The walk starts 40 deviations below the mean (what lies below has no weight in double precision) and ends beyond the
    largest u, so it takes a number of steps in the order of the root of the rate, and holds _TERMS of them.
    """
    out = np.zeros(len(u), np.int64)
    if not rate > 0 or not len(u):
        return out
    begin = max(0, math.floor(rate - 40 * math.sqrt(rate) - 40))
    last = rate + 12 * math.sqrt(rate) + 40
    order = np.argsort(u, kind="stable")
    total, at = 0.0, 0
    k = begin
    while at < len(order) and k <= last:
        sums = np.minimum(total + np.cumsum(_poisson_terms(rate, np.arange(k, k + _TERMS, dtype=float))), 1.0)
        end = at + int(np.searchsorted(u[order[at:]], sums[-1]))
        out[order[at:end]] = k + np.searchsorted(sums, u[order[at:end]], "right")
        at, total, k = end, float(sums[-1]), k + _TERMS
    out[order[at:]] = k
    return out


def _identity(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text_col, F.lit("")))))


def uniform(seed: int, what: str, *parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed, purpose and parts."""
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}|{what}"), *parts))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def mixing_rates(docs: DataFrame, weights: Mapping[str, float], total_factor: float = 1.0, source_col: str = "source", text_col: str = "text") -> dict[str, float]:
    """Mean repetitions of a document of each named source (and ``*``), from the bytes of text of every source.

    rate = weight share x total_factor x bytes of the corpus / bytes of the source. Shares are taken over the
    sources that have text at all, so that the mixture keeps its total.
    """
    if len(weights) > MAX_NAMED:
        raise ValueError(f"{len(weights)} named sources; at most {MAX_NAMED}")
    if any(not (w >= 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    mass = docs.groupBy(_bucket(weights, source_col).alias("bucket")).agg(F.sum(F.octet_length(F.coalesce(text_col, F.lit("")))).alias("mass"))
    masses = {r.bucket: r.mass for r in mass.collect() if r.mass}  # at most one row per named source and one more
    corpus = sum(masses.values())
    share = sum(weights.get(b, 0.0) for b in masses)
    return {b: weights.get(b, 0.0) / share * total_factor * corpus / m if share else 0.0 for b, m in masses.items()}


def _bucket(weights: Mapping[str, float], source_col: str) -> Column:
    named = [s for s in weights if s != OTHER]
    return F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    total_factor: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    prefix: str = "mix_",
) -> DataFrame:
    """Repeat every document by a Poisson count with its source's rate and shuffle the copies globally.

    Adds ``mix_bucket``, ``mix_rate``, ``mix_copies``, ``mix_copy`` (1 to copies) and ``mix_key`` (double in [0, 1)) to the
    columns of ``docs``, replacing columns of these names; rows stand in order of mix_key inside each of the shuffled partitions. The count inverts the
    Poisson distribution at a uniform number hashed from seed and id, so it doesn't depend on partitioning or
    retries; rows that repeat an id get the same count each. A null id is hashed by its text; a null source counts
    as unnamed; a source with weight 0 (or unnamed without ``*``) has no copies. Texts that are null or empty have no
    mass but are copied like others of their source; where a whole source has no mass its rate is 0. An empty table
    gives an empty result. Columns of any name pass.

    The rate table has at most MAX_NAMED + 1 rows and becomes part of the plan. Only rate and uniform number go to Python. One
    shuffle moves the copies, by a hash of the key, so a hot source is spread like any other.
    """
    rates = mixing_rates(docs, weights, total_factor, source_col, text_col)
    added = [f"{prefix}{x}" for x in ("bucket", "rate", "copies", "copy", "key")]
    own = [c for c in docs.columns if c not in added]
    spark = docs.sparkSession
    bound_batches(spark)
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*name.values()).select(*name.values(), _bucket(weights, name[source_col]).alias("bucket"), _identity(name[id_col], name[text_col]).alias("ident"))
    # from Arrow, the table is a local one; from a list it is a Python RDD, and every executor starts a second daemon and its workers to read it
    table = spark.createDataFrame(pa.table([pa.array(rates.keys(), pa.string()), pa.array(rates.values(), pa.float64())], ["bucket", "rate"]))
    rows = rows.join(F.broadcast(table), "bucket", "left")

    @F.pandas_udf("long")
    def counted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rate, u in parts:
            out = np.zeros(len(rate), np.int64)
            for r in rate.dropna().unique():
                mine = (rate == r).to_numpy()
                out[mine] = poisson_quantiles(float(r), u[mine].to_numpy())
            yield pd.Series(out)

    # else the filter is pushed below and counts a second time, by another worker of the same task
    counted = counted.asNondeterministic()
    rows = rows.withColumn("copies", counted("rate", uniform(seed, "count", F.col("ident")))).where("copies > 0")
    # blocks first: one array of all copies of a document would have no bound
    block = F.lit(COPY_BLOCK).cast("long")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("block") * block + 1, F.least(F.col("copies"), (F.col("block") + 1) * block))))
    rows = rows.withColumn("key", uniform(seed, "place", F.col("ident"), F.col("copy").cast("string")))
    out = rows.repartition(F.col("key")).sortWithinPartitions("key")
    return out.select(*(F.col(name[c]).alias(c) for c in own), *(F.col(x).alias(f"{prefix}{x}") for x in ("bucket", "rate", "copies", "copy", "key")))
