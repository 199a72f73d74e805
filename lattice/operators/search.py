"""Result lists: rank fusion, prefilters and top-k with coverage (``pruned`` and ``patterns`` make the lists)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts every partition to k before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def ordered_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The sum of each key, added up row by row in order: a sum of doubles, and a rank by it, is the same however the rows are split."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(*keys, running.alias(name), F.lead(F.lit(True)).over(w).isNull().alias("_last")).where("_last").drop("_last")


def fuse(lists: Sequence[DataFrame], keys: Sequence[str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists with a column rank: the sum of 1 / (k + rank); the rank of each list stays, null where absent."""
    tagged = [df.select(*keys, F.lit(i).alias("_list"), "rank") for i, df in enumerate(lists)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    ranks = [F.min(F.when(F.col("_list") == i, F.col("rank"))).alias(f"rank_{i + 1}") for i in range(len(lists))]
    return every.groupBy(*keys).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("fused"), *ranks)


def covered_top_k(scored: DataFrame, group: Sequence[str], cover: str, order: Sequence[Column], k: int) -> DataFrame:
    """Top k of each group, the best of every ``cover`` value first, then the rest by order."""
    best = Window.partitionBy(*group, cover).orderBy(*order)
    marked = scored.withColumn("_later", (F.row_number().over(best) > 1).cast("int"))
    return top_k(marked, group, [F.asc("_later"), *order], k).drop("_later")


def category_top_k(scored: DataFrame, group: Sequence[str], category: str, order: Sequence[Column], k: int) -> DataFrame:
    """Top k; the best of every category is in if k is at least the number of categories, else the plain cut."""
    best = Window.partitionBy(*group, category).orderBy(*order)
    n = scored.groupBy(*group).agg(F.count_distinct(category).alias("_n"))
    marked = scored.join(n, list(group)).withColumn("_later", F.when(F.col("_n") <= k, (F.row_number().over(best) > 1).cast("int")).otherwise(0))
    return top_k(marked, group, [F.asc("_later"), *order], k).drop("_later", "_n")


def positive_or_all(scored: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """Rows with a positive score; all rows of a group without one."""
    w = Window.partitionBy(*group)
    return scored.withColumn("_best", F.max(score).over(w)).where((F.col(score) > 0) | (F.col("_best") <= 0)).drop("_best")


def round_robin(rows: DataFrame, queue: Sequence[str], order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """Interleave queues: the first of every queue in key order, then the second, and so on. Adds ``turn`` and ``position``."""
    turn = Window.partitionBy(*group, *queue).orderBy(*order)
    placed = rows.withColumn("turn", F.row_number().over(turn).cast("long"))
    return placed.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("turn", *queue)).cast("long"))


def keyword_prefilter(docs: DataFrame, groups: DataFrame, name: str, description: str, minimum: float = 0.0) -> DataFrame:
    """Score documents by the keywords (array ``keywords``) of each group; groups are a bounded, broadcast query set.

    0.45 if a keyword of several words stands in the name, 0.30 x share of keywords in it; 0.15 and 0.10 likewise for the description.
    """
    n, d, k = F.lower(name), F.lower(description), F.col("keywords")
    phrase = lambda t: F.exists(k, lambda w: F.contains(w, F.lit(" ")) & F.contains(t, w)).cast("double")
    share = lambda t: F.size(F.filter(k, lambda w: F.forall(F.split(w, " "), lambda x: F.contains(t, x)))) / F.greatest(F.size(k), F.lit(1))
    score = F.least(F.lit(1.0), 0.45 * phrase(n) + 0.30 * share(n) + 0.15 * phrase(d) + 0.10 * share(d))
    table = groups.collect()
    pairs = F.explode(F.array(*(F.struct(F.lit(r["group_ref"]).alias("group_ref"), F.array(*map(F.lit, r["keywords"])).alias("keywords")) for r in table)))
    return docs.withColumn("_g", pairs).select(*docs.columns, "_g.*").withColumn("score", F.round(score, 6)).where(F.col("score") > minimum).drop("keywords")


def informative_prefilter(matches: DataFrame, n_docs: int, group: str, doc: str, keep: float = 0.6, least_idf: float = 0.35) -> DataFrame:
    """(group, doc, score) of (group, doc, term, in_name): informative terms weigh idf x (1 in the name, .45 else) x length weight; keep those of at least ``keep`` of the best."""
    df = matches.groupBy(group, "term").agg(F.count_distinct(doc).alias("df"))
    idf = F.log((n_docs + 1) / (F.col("df") + 1)) / F.log(F.lit(float(n_docs + 1)))
    weighted = matches.join(df.withColumn("idf", idf).where(F.col("idf") >= least_idf), [group, "term"])
    part = F.col("idf") * F.when(F.col("in_name"), 1.0).otherwise(0.45) * F.greatest(F.lit(0.5), F.least(F.lit(1.75), F.length("term") / 4))
    scored = weighted.groupBy(group, doc).agg(F.round(F.sum(part), 6).alias("score"))
    best = F.max("score").over(Window.partitionBy(group))
    return scored.withColumn("_best", best).where(F.col("score") >= keep * F.col("_best")).drop("_best")


def scarcity(matches: DataFrame, candidate: str, group: str) -> DataFrame:
    """Gain of each candidate: the sum over its groups of 1 / candidates in the group."""
    sizes = matches.groupBy(group).agg(F.count_distinct(candidate).alias("_n"))
    return matches.select(candidate, group).distinct().join(sizes, group).groupBy(candidate).agg(F.round(F.sum(1 / F.greatest("_n", F.lit(1))), 9).alias("gain"), F.count(F.lit(1)).alias("groups"))


def predicate_fusion(rows: DataFrame, predicate: str, unit: str, exhaustive: bool = False, visual_threshold: float = 62.0) -> DataFrame:
    """Fuse lexical, model, vector and visual scores (0 to 100, null where absent) of (predicate, unit, grounding).

    Each channel ranks its own scores; r = mean of 1 / (60 + rank) over the channels present, times 6100. Score = .82 x max(lexical,
    grounded model, min(vector, 70)) + .18 x min(100, r). A unit passes with lexical of 60, a grounded model of 55 (35 if
    exhaustive) or a visual score at the threshold, and a score of 60 (35); 12 a predicate unless exhaustive.
    """
    low = 35.0 if exhaustive else 55.0
    cut = 35.0 if exhaustive else 60.0
    model = F.when(F.col("grounding") >= 0.35, F.col("model"))
    out = rows.withColumn("_model", model)
    parts = []
    for c in ("lexical", "_model", "vector", "visual"):
        out = out.withColumn(f"_r_{c}", F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(predicate).orderBy(F.desc_nulls_last(c)))))
        parts.append(F.when(F.col(f"_r_{c}").isNotNull(), 1 / (60 + F.col(f"_r_{c}"))))
    present = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    r = F.when(present > 0, total / present * 6100).otherwise(0.0)
    zero = F.lit(0.0)
    base = F.greatest(F.coalesce("lexical", zero), F.coalesce("_model", zero), F.least(F.coalesce("vector", zero), F.lit(70.0)))
    scored = out.withColumn("score", F.round(0.82 * base + 0.18 * F.least(F.lit(100.0), r), 6))
    gate = (F.coalesce("lexical", zero) >= 60) | (F.coalesce("_model", zero) >= low) | (F.coalesce("visual", zero) >= visual_threshold)
    passed = scored.where(gate & (F.col("score") >= cut)).select(predicate, unit, "score")
    return top_k(passed, [predicate], [F.desc("score"), F.asc(unit)], 2**31 - 1 if exhaustive else 12)
