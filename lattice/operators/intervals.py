"""Interval operators. Conventions stand in each name: half-open [start, end), or inclusive integers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps_half_open(start: Column, end: Column, scope_start: Column, scope_end: Column) -> Column:
    return (end > scope_start) & (start < scope_end)


def merge_touching(rows: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", gap: float = 0.0) -> DataFrame:
    """Union of intervals that overlap, touch, or lie at most ``gap`` apart, with the number of members.

    A row opens a new group if it starts beyond the largest end before it; groups are summed by key and number.
    """
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*keys).orderBy(start, end)
    opened = rows.withColumn("_new", F.coalesce((F.col(start) > F.max(end).over(before) + gap).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("_group")


def subtract_inclusive(ranges: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inclusive integer ranges less inclusive integer masks: what lies between the merged masks of each range."""
    merged = merge_touching(masks.select(*keys, "start", "end"), keys, gap=1).select(*keys, F.col("start").alias("ms"), F.col("end").alias("me"))
    r = ranges.select(*keys, F.col("start").alias("rs"), F.col("end").alias("re"))
    hit = r.join(merged, list(keys)).where((F.col("ms") <= F.col("re")) & (F.col("me") >= F.col("rs")))
    # a mask just behind each range: what is left always ends before some mask
    every = hit.unionByName(r.withColumns({"ms": F.col("re") + 1, "me": F.col("re") + 1}))
    w = Window.partitionBy(*keys, "rs", "re").orderBy("ms")
    left = every.select(*keys, F.coalesce(F.lag("me").over(w) + 1, F.col("rs")).alias("start"), (F.col("ms") - 1).alias("end"))
    return left.where("start <= end")


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float, l_start: str = "l_start", l_end: str = "l_end", r_start: str = "r_start", r_end: str = "r_end") -> DataFrame:
    """Pairs of half-open intervals that overlap, by equal keys and bins of ``width``; each pair once, in the bin of its later start.

    An equi-join on bins shuffles (or broadcasts) like any other join, where the bare inequality would be a nested loop.
    """

    def binned(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(b) > F.col(a)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(a) / width), F.ceil(F.col(b) / width) - 1)))

    joined = binned(left, l_start, l_end).join(binned(right, r_start, r_end), [*keys, "_bin"])
    overlap = (F.col(l_end) > F.col(r_start)) & (F.col(l_start) < F.col(r_end))
    return joined.where(overlap & (F.col("_bin") == F.floor(F.greatest(l_start, r_start) / width))).drop("_bin")


def bands(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Runs of consecutive integers as (start, end, size), repeats counted once."""
    w = Window.partitionBy(*keys).orderBy(value)
    islands = rows.select(*keys, value).distinct().withColumn("_island", F.col(value) - F.row_number().over(w))
    return islands.groupBy(*keys, "_island").agg(F.min(value).alias("start"), F.max(value).alias("end"), F.count(F.lit(1)).alias("size")).drop("_island")


def split_at_largest_gaps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, parts: int) -> DataFrame:
    """Number the ``parts`` groups that the parts - 1 largest gaps between neighbours separate (earlier gaps first on ties)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gaps = rows.withColumn("_gap", F.col(start) - F.lag(end).over(w)).withColumn("_pos", F.row_number().over(w))
    ranked = gaps.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_gap"), "_pos")))
    cut = (F.col("_gap").isNotNull() & (F.col("_rank") < parts)).cast("int")
    return ranked.withColumn("part", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_gap", "_pos", "_rank")


def best_overlap(points: DataFrame, segments: DataFrame, keys: Sequence[str], point_id: str, width: float) -> DataFrame:
    """The segment of largest overlap for each interval (the first by number on ties); segment 0 where nothing overlaps."""
    pairs = range_join(points.select(*keys, point_id, F.col("start").alias("l_start"), F.col("end").alias("l_end")), segments.select(*keys, F.col("segment"), F.col("start").alias("r_start"), F.col("end").alias("r_end")), keys, width)
    size = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    best = pairs.groupBy(*keys, point_id).agg(F.max_by("segment", F.struct(F.round(size, 9), -F.col("segment"))).alias("segment"))
    return points.select(*keys, point_id).join(best, [*keys, point_id], "left").withColumn("segment", F.coalesce("segment", F.lit(0)))


def kept_cuts(cuts: Column, gap: int) -> Column:
    """Sorted cut positions of which each kept one lies at least ``gap`` behind the last kept: a fold, since a plain lag compares with dropped ones."""
    sorted_cuts = F.array_sort(cuts)
    return F.aggregate(sorted_cuts, F.array().cast("array<long>"), lambda acc, c: F.when((F.size(acc) == 0) | (c - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(c.cast("long")))).otherwise(acc))


def contained(rows: DataFrame, keys: Sequence[str], row_id: str, width: float, share: float = 0.96, longer: float = 0.2) -> DataFrame:
    """(keys, child, outer) where at least ``share`` of the child lies in an outer interval longer by more than ``longer``."""
    a = rows.select(*keys, F.col(row_id).alias("child"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = rows.select(*keys, F.col(row_id).alias("outer"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = range_join(a, b, keys, width).where("child != outer")
    size = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    inner = F.col("l_end") - F.col("l_start")
    return pairs.where((size >= share * inner) & (F.col("r_end") - F.col("r_start") > inner + longer)).select(*keys, "child", "outer")
