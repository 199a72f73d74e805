"""Quality rules: fixed limits, then robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import U64, flat, gram_hashes, map_arrow, mix, pieces, word_bounds, word_hashes, written

WINDOW = 8
#: Share of a group's rows that the covariance is estimated on.
SUPPORT = 0.75
#: A start is settled when a concentration step lowers the log of its determinant by no more than this.
SETTLED = 1e-9
#: Groups with fewer rows use their language's estimate, and languages with fewer the estimate over all.
LEAST_ROWS = 60
#: Squared distance beyond which a document is rejected: the 0.999 quantile of the chi-square distribution with four degrees of freedom.
CUTOFF = 18.4668
#: Group tables up to this many rows are broadcast (some megabytes); larger ones are left to Spark.
MAX_BROADCAST_GROUPS = 50_000
#: Starts of the concentration steps of every group; the one that ends at the least determinant counts.
STARTS = ("medians", "means", "half")
#: Least standard deviation of each transformed statistic: differences below it never count as odd.
FLOORS = (0.05, 0.10, 0.12, 0.12)
DIMS = len(FLOORS)
#: Median of the chi-square distribution with four degrees of freedom.
_MEDIAN_CHI2 = 3.35669
_ESTIMATE = ("mu", "cov", "inverse", "log_det")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _repeats(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how often it stands in its document, and whether this is its first place there."""
    _, first, where, counts = np.unique(mix(keys + mix(docs.astype(U64))), return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return counts[where], is_first


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of one piece of a batch."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first)
    of_word = np.repeat(np.arange(n), words)
    characters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=characters[1:])
    out = {"n_words": words, "word_chars": _per_doc(characters[ends] - characters[starts], first), "n_symbols": _per_doc(_SYMBOL[data], offsets)}

    # lines that hold a word: those some word starts in
    breaks = np.flatnonzero(data == 10)
    edges = np.union1d(breaks + 1, offsets[:-1])
    edges = edges[edges < len(data)] if len(data) else edges[:0]
    stops = np.append(edges[1:], len(data)) if len(edges) else edges
    stops = np.where((stops > 0) & (data[np.maximum(stops - 1, 0)] == 10) & (stops > edges), stops - 1, stops) if len(edges) else stops
    full = np.unique(np.searchsorted(edges, starts, "right") - 1) if len(starts) else np.zeros(0, np.int64)
    of_line = np.searchsorted(offsets, edges[full], "right") - 1 if len(full) else full
    _, is_first = _repeats(word_hashes(data, edges[full], stops[full]), of_line) if len(full) else (None, np.zeros(0, bool))
    out["n_lines"] = np.bincount(of_line, minlength=n)[:n]
    out["n_dup_lines"] = np.bincount(of_line, ~is_first, n)[:n].astype(np.int64)

    covered = np.zeros(len(starts) + 1, np.int64)
    grams = gram_hashes(word_hashes(data, starts, ends), WINDOW)
    inside = of_word[: len(grams)] == of_word[WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    if len(at):
        counts, _ = _repeats(grams[at], of_word[at])
        at = at[counts > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(covered[:-1]) > 0, first)
    return out


def with_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, in a struct ``_stats``, the counts of each text."""
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    source = docs.select(F.col(text_col).alias("_text"), *kept)
    schema = T.StructType([*(f for f in source.schema.fields if f.name != "_text"), *(T.StructField(c, T.LongType()) for c in _COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            parts: dict[str, list[np.ndarray]] = {c: [np.zeros(0, np.int64)] for c in _COUNTS}
            for a, b in pieces(offsets):
                for c, v in statistics_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).items():
                    parts[c].append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(np.concatenate(parts[c]), pa.int64()) for c in _COUNTS)], schema.names)

    out = map_arrow(source, count, schema)
    return out.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), F.struct(*_COUNTS).alias("_stats"))


def base_failed() -> Column:
    s = F.col("_stats")
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def transformed() -> list[Column]:
    """Log of the mean word length, and square roots of symbols a word, of the share of repeated lines and of repeated words.

    Short texts are drawn towards ordinary values by some virtual words and lines. Values lie on a grid of 1 / 1024, so
    that exact quantiles need a bounded number of distinct values.
    """
    s = F.col("_stats")
    raw = (
        F.log((s["word_chars"] + 50 * 6.0) / (s["n_words"] + 50)),
        F.sqrt(s["n_symbols"] / (s["n_words"] + 50)),
        F.sqrt(s["n_dup_lines"] / (s["n_lines"] + 10)),
        F.sqrt(s["n_repeat_words"] / (s["n_words"] + 50)),
    )
    return [F.round(F.least(c, F.lit(16.0)) * 1024) / 1024 for c in raw]


def _distance() -> Column:
    """Squared Mahalanobis distance of x to the group's centre, on a grid of its logarithm."""
    diff = [F.col("x")[i] - F.col("mu")[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        total = total + F.col("inverse")[i * DIMS + i] * diff[i] * diff[i]
        for j in range(i):
            total = total + 2 * F.col("inverse")[i * DIMS + j] * diff[i] * diff[j]
    return F.round(F.log(1 + F.greatest(total, F.lit(0.0))) * 1024) / 1024


def _inverses(moments: DataFrame, keys: list[str]) -> DataFrame:
    """mu, cov, the inverse of the covariance with the floors on its diagonal, and the log of its determinant, for each group."""
    schema = T.StructType([*(moments.schema[k] for k in keys), moments.schema["mu"], moments.schema["cov"], T.StructField("inverse", T.ArrayType(T.DoubleType())), T.StructField("log_det", T.DoubleType())])

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            inverse, log_det = [], []
            for cov, scale in zip(f["cov"], f["scale"], strict=True):
                matrix = np.asarray(cov, float).reshape(DIMS, DIMS) * scale + np.diag(np.square(FLOORS))
                inverse.append(np.linalg.inv(matrix).ravel().tolist())
                log_det.append(float(np.linalg.slogdet(matrix)[1]))
            yield f[[*keys, "mu", "cov"]].assign(inverse=inverse, log_det=log_det)

    return moments.mapInPandas(invert, schema)


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """mu and cov of each group."""
    aggregates = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(DIMS)]
    aggregates += [F.covar_pop(F.col("x")[i], F.col("x")[j]).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    sums = rows.groupBy(keys).agg(*aggregates)
    cov = [F.col(f"c{max(i, j)}{min(i, j)}") for i in range(DIMS) for j in range(DIMS)]
    return sums.select(*keys, F.array(*(f"m{i}" for i in range(DIMS))).alias("mu"), F.array(*cov).alias("cov"))


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Which estimate each (lang, source) uses: its own, its language's or that of all.

    Returns the map, the rows once for each estimate they belong to, and whether the groups are few.
    """
    cells = written(rows.groupBy("lang_k", "source_k").agg(F.count(F.lit(1)).alias("n")), "sizes")
    by_lang = cells.groupBy("lang_k").agg(F.sum("n").alias("n_lang"))
    both = cells.join(by_lang, "lang_k")
    own, lang = F.col("n") >= LEAST_ROWS, F.col("n_lang") >= LEAST_ROWS
    used = both.select(
        "lang_k",
        "source_k",
        F.when(own | lang, F.concat(F.lit("="), "lang_k")).otherwise("*").alias("lang_g"),
        F.when(own, F.concat(F.lit("="), "source_k")).otherwise("*").alias("source_g"),
    )
    used = written(used, "groups")
    few = used.count() <= MAX_BROADCAST_GROUPS
    # a pooled estimate rests on every row of its language, not only on the rows that use it
    needed = used.select("lang_g", "source_g").where("source_g = '*'").distinct()
    pooled = rows.select("x", F.explode(F.array(F.concat(F.lit("="), "lang_k"), F.lit("*"))).alias("lang_g"), F.lit("*").alias("source_g")).join(_small(needed, few), ["lang_g", "source_g"], "left_semi")
    single = rows.join(_small(used.where("source_g != '*'"), few), ["lang_k", "source_k"]).select("x", "lang_g", "source_g")
    return used, single.unionByName(pooled), few


def _small(groups: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(groups) if few else groups


def _key(column: str) -> Column:
    """The value behind a sign; null has a sign of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("!"))


def _step(rows: DataFrame, estimate: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """One concentration step of each (group, start) of the estimate."""
    near = rows.join(_small(estimate, few), keys[:2]).select(*keys, "x", _distance().alias("d"))
    limits = written(near.groupBy(keys).agg(F.percentile("d", F.lit(SUPPORT)).alias("limit")), "limits")
    chosen = near.join(_small(limits, few), keys).where("d <= limit")
    return written(_inverses(_moments(chosen, keys).withColumn("scale", F.lit(1.0)), keys), "moments")


def fit(statistics: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Estimates for every (lang_k, source_k): mu and inverse. ``statistics`` has the two columns and ``_stats``.

    STARTS of every group: medians with median deviations, means with the covariance of all rows, and the moments of the half
    of the rows that lie nearest to the medians. From each, concentration steps: the SUPPORT share of rows nearest
    to the centre gives the next mean and covariance. All groups and starts advance together and every step is a sum over all
    rows with partial aggregation, so a group that holds a third of the rows is no more work for any task than others.
    A start whose determinant no longer falls keeps the estimate before that step and leaves: floors, ties and the grid of
    distances let subsets turn in a circle, determinants can only fall so far. Then the start with the least determinant counts
    (the first on ties).
    """
    usable = statistics.where(~base_failed()).select(_key(lang_col).alias("lang_k"), _key(source_col).alias("source_k"), F.array(*transformed()).alias("x"))
    used, rows, few = grouped(usable)
    group, keys = ["lang_g", "source_g"], ["lang_g", "source_g", "start"]
    rows = written(rows, "points")
    medians = rows.groupBy(group).agg(F.array(*(F.percentile(F.col("x")[i], F.lit(0.5)) for i in range(DIMS))).alias("mu"))
    medians = written(medians, "medians")
    away = rows.join(_small(medians, few), group)
    spread = away.groupBy(group).agg(F.first("mu").alias("mu"), F.array(*(F.percentile(F.abs(F.col("x")[i] - F.col("mu")[i]), F.lit(0.5)) for i in range(DIMS))).alias("mad"))
    zero, one = F.lit(0.0), F.lit(1.0)
    diagonal = F.array(*((F.pow(1.4826 * F.col("mad")[i], F.lit(2.0)) if i == j else zero) for i in range(DIMS) for j in range(DIMS)))
    first = spread.select(*group, F.lit(STARTS[0]).alias("start"), "mu", diagonal.alias("cov"))
    second = _moments(rows, group).select(*group, F.lit(STARTS[1]).alias("start"), "mu", "cov")
    started = written(_inverses(first.unionByName(second).withColumn("scale", one), keys), "start")
    near = rows.join(_small(started.where(F.col("start") == STARTS[0]), few), group).select(*group, "x", _distance().alias("d"))
    half = near.join(_small(written(near.groupBy(group).agg(F.percentile("d", F.lit(0.5)).alias("limit")), "halves"), few), group).where("d <= limit")
    third = _inverses(_moments(half, group).select(*group, F.lit(STARTS[2]).alias("start"), "mu", "cov").withColumn("scale", one), keys)
    estimate = written(started.unionByName(third), "start")
    # the starts are no subsets of SUPPORT rows: the first step counts in any case
    estimate = written(_step(rows, estimate, keys, few).withColumn("moving", F.lit(True)), "step")
    while estimate.where("moving").limit(1).count():
        after = _step(rows, estimate.where("moving").drop("moving"), keys, few)
        new = after.select(*keys, *(F.col(c).alias(f"new_{c}") for c in _ESTIMATE))
        fell = F.coalesce(F.col("new_log_det") < F.col("log_det") - SETTLED, F.lit(False))
        joined = estimate.join(new, keys, "left").withColumn("fell", fell)
        estimate = written(joined.select(*keys, *(F.when(F.col("fell"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in _ESTIMATE), F.col("fell").alias("moving")), "step")
    order = F.struct(F.round("log_det", 9), F.array_position(F.array(*map(F.lit, STARTS)), F.col("start")))
    best = written(estimate.groupBy(group).agg(F.min_by("start", order).alias("start")), "best")
    # consistency: the median distance of the group's rows becomes that of the chi-square distribution
    plain = written(estimate.join(best, keys), "plain")
    medians = rows.join(_small(plain, few), group).select(*group, _distance().alias("d")).groupBy(group).agg(F.percentile("d", F.lit(0.5)).alias("d"))
    scaled = plain.select(*group, "mu", "cov").join(medians, group).withColumn("scale", F.greatest(one, F.expm1("d") / _MEDIAN_CHI2))
    return written(used.join(_inverses(scaled.select(*group, "mu", "cov", "scale"), group), group).select("lang_k", "source_k", "mu", "inverse"), "estimates")


def judged(statistics: DataFrame, estimates: DataFrame, lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Add base_failed, distance (squared; null without an estimate) and kept."""
    rows = statistics.withColumns({"lang_k": _key(lang_col), "source_k": _key(source_col), "x": F.array(*transformed())})
    few = estimates.count() <= MAX_BROADCAST_GROUPS
    out = rows.join(_small(estimates, few), ["lang_k", "source_k"], "left").withColumns({"base_failed": base_failed(), "distance": F.expm1(_distance())})
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.withColumn("kept", kept).drop("lang_k", "source_k", "x", "mu", "inverse")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    A null or empty text has no words and fails the base rule. Null languages and sources form groups of their own.
    Groups below LEAST_ROWS usable rows take their language's estimate or that of all rows; where nothing is usable,
    only the base rule decides. Repeated rows count each and get equal verdicts; null ids pass through; columns other
    than the four named are not read. An empty table gives no rows.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    statistics = written(with_statistics(picked, "text", ["doc_id", "lang", "source"]), "statistics")
    out = judged(statistics, fit(statistics), cutoff=cutoff)
    return out.select("doc_id", *(F.col("_stats")[c].alias(c) for c in _COUNTS if c != "n_lines"), "base_failed", "distance", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Estimates come from a first pass, verdicts from a second, so that no join carries texts."""
    keys = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    estimates = fit(written(with_statistics(keys, "text", ["lang", "source"]), "statistics"))
    numbered = [f"c{i}" for i in range(len(docs.columns))]
    again = docs.toDF(*numbered)
    name = dict(zip(docs.columns, numbered, strict=True))
    out = judged(with_statistics(again, name[text_col], numbered), estimates, name[lang_col], name[source_col], cutoff)
    return out.where("kept").select(*numbered).toDF(*docs.columns)
