"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.common import written

#: A node with more than this share of all links is heavy; fewer than 1 / share nodes can be.
HEAVY = 1 / 1000


def _with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Links (u, v) with the least neighbour m of u. ``least`` has u, m and the number n of the ``total`` links of u.

    Heavy nodes (fewer than 1 / HEAVY of them, whatever the size) meet their links by broadcast, all others in a shuffle
    join, so no task gets the links of a heavy node.
    """
    heavy = least.where(F.col("n") > total * HEAVY).select("u", F.col("m").alias("h"))
    marked = links.join(F.broadcast(heavy), "u", "left")
    light = marked.where("h is null").select("u", "v").join(least.where(F.col("n") <= total * HEAVY).select("u", "m"), "u")
    return marked.where("h is not null").select("u", "v", F.col("h").alias("m")).unionByName(light.select("u", "v", "m"))


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over ``total`` directed edges (u, v), u > v.

    Large star: every neighbour above u is linked to the least of u and its neighbours. Small star: every neighbour
    below u, and u itself, is linked to the least neighbour. The least neighbour comes from an aggregation with partial sums.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        linked = _with_least(both.where("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        below = _with_least(edges, least, total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = below.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge: component is the least node reachable.

    ``edges`` has two columns of one integer type, in any direction; loops, repeats and nulls are ignored. Ends when a
    round changes nothing (a logarithmic number of rounds); every step is written to the shared folder.
    """
    a, b = edges.columns
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    current = written(current.distinct(), "edges")

    def state(df: DataFrame) -> tuple[int, str | None]:
        """Stars that no longer change have the same number of edges and the same sums."""
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string")).first())

    before = state(current)
    for _ in range(max_rounds if before[0] else 0):
        large = written(_star(current, True, before[0]), "edges")
        current = written(_star(large, False, large.count()), "edges")
        now = state(current)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
