"""Rule operators over parts, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.catalog import table
from lattice.operators import folds, rules
from lattice.plans.registry import query


@query("facet_filter", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red') AND contains(p_type, 'PROMO')")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(rules.facets_like({"p_name": "red", "p_type": " PROMO ", "p_brand": "", "p_size": None})).select("p_partkey", "p_name")


@query("hard_unit_filter", """
SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND (contains(lower(text), 'the ') OR contains(lower(text), 'und ')) AND NOT contains(lower(text), 'tion')""")
def hard_unit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = rules.hard_filter(F.col("text"), F.col("role"), ["user", "assistant"], speakers=["The ", "und "], exclusions=["TION", ""])
    return table(spark, sf_dir, "conversations").where(keep).select("conv_id", "turn")


@query("scope_resolution", """
WITH d AS (SELECT conv_id, max(turn) * 100.0::DOUBLE + 50 AS total FROM conversations GROUP BY 1), k(kind) AS (VALUES ('all'), ('opening'), ('middle'), ('ending'), ('custom')),
s AS (SELECT conv_id, kind, total, CASE kind WHEN 'middle' THEN total * 0.25 WHEN 'ending' THEN total - least(total * 0.15, 600) WHEN 'custom' THEN least(total, 120) ELSE 0 END AS lo,
  CASE kind WHEN 'opening' THEN least(total * 0.15, 600) WHEN 'middle' THEN total * 0.75 WHEN 'custom' THEN least(total, 260) ELSE total END AS hi FROM d, k)
SELECT conv_id, kind, round_even(lo, 3) AS "start", round_even(hi, 3) AS "end", round_even(greatest(hi - lo, 0), 3) AS duration, total > 0 AND (lo > 0.001 OR hi < total - 0.001) AS narrow, hi <= lo AS "empty" FROM s""")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") * 100.0 + 50).alias("total"))
    kinds = F.explode(F.array(*map(F.lit, ("all", "opening", "middle", "ending", "custom")))).alias("kind")
    rows = total.select("conv_id", "total", kinds)
    return rows.select("conv_id", "kind", rules.scope(F.col("total"), F.col("kind"), F.lit(120.0), F.lit(260.0)).alias("s")).select("conv_id", "kind", "s.*")


@query("representative_sampling", """
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM n WHERE pos IN (0, round_even(1.0 * (n - 1) / 3, 0)::INT, round_even(2.0 * (n - 1) / 3, 0)::INT, n - 1)""")
def representative_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evenly(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("richest_sibling", """
WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal, floor(s_acctbal / 1000) AS r FROM supplier)
SELECT s_nationkey, arg_max(s_suppkey, (r, -s_suppkey)) AS s_suppkey, min(s_suppkey) AS position FROM s GROUP BY 1""")
def richest_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return rules.richest(rows, ["s_nationkey"], F.floor(F.col("s_acctbal") / 1000), "s_suppkey").select("s_nationkey", "s_suppkey", "position")


@query("distinct_hits_topk", """
WITH o AS (SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1)
SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM o QUALIFY rank <= 3""")
def distinct_hits_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return rules.distinct_hits(hits, "user_id", F.col("event_type"), [F.desc("value"), F.asc("event_id")], 3)


@query("weak_headings")
def weak_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = lines.select("doc_id", "pos", rules.weak_heading_level(F.col("line")).alias("level"), rules.toc_entry(F.col("line")).alias("toc"), rules.figure_title(F.col("line")).alias("figure"))
    return found.groupBy("doc_id").agg(F.count("level").alias("headings"), F.count_if("toc").alias("toc_lines"), F.count_if("figure").alias("figures"), F.count(F.lit(1)).alias("lines"))


@query("contents_lines", """
WITH l AS (SELECT doc_id, source || CASE doc_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' WHEN 2 THEN ' ... ' WHEN 3 THEN '·•' ELSE repeat(' chapter', 10) || '  ' END || (doc_id % 1000)::VARCHAR AS line FROM documents)
SELECT doc_id, line, (length(line) <= 80 AND regexp_matches(line, '[·•\\s]{2,}\\d{1,4}$')) OR regexp_matches(line, '[.…·•。．\\s]{3,}\\s*\\d{1,4}$') AS entry FROM l""")
def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and numbers as lines of a table of contents: two blanks, one, dots, middle dots, and two blanks in a long line."""
    kind = F.col("doc_id") % 5
    gap = F.when(kind == 0, "  ").when(kind == 1, " ").when(kind == 2, " ... ").when(kind == 3, "·•").otherwise(" chapter" * 10 + "  ")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", gap, (F.col("doc_id") % 1000).cast("string")).alias("line"))
    return lines.select("doc_id", "line", rules.toc_entry(F.col("line")).alias("entry"))


@query("heading_levels", """
WITH RECURSIVE r AS (SELECT user_id, event_id * 7 % 9 + 1 AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
d AS (SELECT user_id, i, dense_rank() OVER (PARTITION BY user_id ORDER BY l) AS k FROM r),
w AS (
  SELECT user_id, i, least(k, 2, 6) AS level FROM d WHERE i = 1
  UNION ALL SELECT d.user_id, d.i, least(d.k, w.level + 1, 6) FROM w JOIN d ON d.user_id = w.user_id AND d.i = w.i + 1)
SELECT user_id, string_agg(level::VARCHAR, ',' ORDER BY i) AS packed, count(*) AS n FROM w GROUP BY 1""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 1 to 9 as raw levels: some are packed, jumps are cut, six is the deepest."""
    item = F.struct("ts", "event_id", (F.col("event_id") * 7 % 9 + 1).cast("int").alias("l"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    packed = rows.select("user_id", rules.normal_levels(F.col("s.l")).alias("levels"))
    return packed.select("user_id", F.array_join(F.transform("levels", lambda v: v.cast("string")), ",").alias("packed"), F.size("levels").cast("long").alias("n"))


@query("document_routing")
def document_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("name"))
    return rules.route(names, [("q1", "what does small ring Brand#2 0 cost"), ("q2", "nothing like it"), ("q3", "red widgt Brand#17 1")], "p_partkey", "name")


@query("subtree_thinning")
def subtree_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"), F.ceil(F.length("text") / 4).alias("tokens"))
    return folds.fold_column(rows, ["conv_id"], ["turn"], ["level", "tokens"], lambda a, b: rules.thin(a, b, 150), "owner", T.LongType())


@query("overlap_free_cues")
def overlap_free_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 4.0
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", start.alias("s"), (start + F.length("text") / 200).alias("e"))

    def decide(s: list[float], e: list[float]) -> list[int]:
        cue = {m: n for n, (_, _, members) in enumerate(rules.untangled(s, e, 1.0)) for m in members}
        return [cue[i] for i in range(len(s))]

    return folds.fold_column(rows, ["conv_id"], ["turn"], ["s", "e"], decide, "cue", T.LongType()).select("conv_id", "turn", "cue")


@query("prediction_truth_overlap", """
WITH p AS (SELECT o_custkey AS k, o_orderkey AS p, o_orderkey % 40 AS ps, o_orderkey % 40 + 12 AS pe FROM orders), t AS (SELECT c_custkey AS k, n AS t, n * 15 AS ts, n * 15 + 15 AS te FROM customer, (SELECT unnest([0, 1, 2]) AS n)),
j AS (SELECT p.k, p, t, least(pe, te) - greatest(ps, ts) AS o FROM p JOIN t ON p.k = t.k AND pe > ts AND ps < te)
SELECT k, p, t AS matched, o AS overlap FROM j QUALIFY row_number() OVER (PARTITION BY k, p ORDER BY o DESC, t) = 1""")
def prediction_truth_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.operators.intervals import range_join

    s = F.col("o_orderkey") % 40
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("p"), s.alias("l_start"), (s + 12).alias("l_end"))
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("t"))
    t = t.select("k", "t", (F.col("t") * 15).cast("long").alias("r_start"), (F.col("t") * 15 + 15).cast("long").alias("r_end"))
    pairs = range_join(p, t, ["k"], 15.0).withColumn("o", F.least("l_end", "r_end") - F.greatest("l_start", "r_start"))
    best = pairs.groupBy("k", "p").agg(F.max_by(F.struct("t", "o"), F.struct("o", -F.col("t"))).alias("b"))
    return best.select("k", "p", F.col("b.t").alias("matched"), F.col("b.o").alias("overlap"))


@query("nested_field_pruning", "SELECT event_id, event_type, value FROM events")
def nested_field_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", "value", "props").alias("raw"))
    return nested.select("event_id", F.col("raw").dropFields("props").alias("raw")).select("event_id", "raw.*")
