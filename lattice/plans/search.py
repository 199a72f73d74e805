"""Keyword search over documents with the benchmark passages as queries, and the merging of result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.catalog import table
from lattice.functions import text as tx
from lattice.operators import patterns, pruned, search
from lattice.plans.registry import query

_INDEX = """
WITH qt AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM benchmark),
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
ln AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n_terms FROM documents),
st AS (SELECT count(*) AS n, avg(n_terms) AS av FROM ln),
ix AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM ix, st GROUP BY term, n),
ur AS (
  SELECT item_id, doc_id, round(sum(idf) / greatest(0.2, 0.25 + 0.75 * any_value(n_terms) / any_value(av)), 6) AS score
  FROM ix JOIN qt USING (term) JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY 1, 2),
th AS (SELECT item_id, doc_id, sum(10 + least(tf, 5))::BIGINT AS score FROM ix JOIN qt USING (term) GROUP BY 1, 2)
"""


def _searched(spark: SparkSession, sf_dir: str, *schemes: tuple[pruned.Scheme, int]) -> DataFrame:
    """The best documents of every passage; A-Z, digits and underscores make words."""
    words = tx.words(F.col("text"))
    return pruned.top_k(table(spark, sf_dir, "documents"), "doc_id", words, table(spark, sf_dir, "benchmark"), "item_id", words, schemes)


@query("hybrid_search_top5", _INDEX + """
, a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ur QUALIFY rank <= 50),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM th QUALIFY rank <= 50),
f AS (SELECT item_id, doc_id, round(sum(1 / (60 + rank)), 9) AS fused, min(CASE WHEN l = 1 THEN rank END) AS rank_1, min(CASE WHEN l = 2 THEN rank END) AS rank_2
      FROM (SELECT item_id, doc_id, rank, 1 AS l FROM a UNION ALL SELECT item_id, doc_id, rank, 2 FROM b) GROUP BY 1, 2)
SELECT item_id, doc_id, fused, rank_1, rank_2, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM f QUALIFY rank <= 5""")
def hybrid_search_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _searched(spark, sf_dir, (pruned.UNIT_RECALL, 50), (pruned.TERM_HITS, 50))
    sparse, phrase = (found.where(F.col("scheme") == s.name) for s in (pruned.UNIT_RECALL, pruned.TERM_HITS))
    fused = search.fuse([sparse, phrase], ["item_id", "doc_id"])
    return search.top_k(fused, ["item_id"], [F.desc("fused"), F.asc("doc_id")], 5)


@query("unit_recall_top10", _INDEX + "SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ur QUALIFY rank <= 10")
def unit_recall_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, (pruned.UNIT_RECALL, 10)).select("item_id", "doc_id", "score", "rank")


@query("bm25_top10", _INDEX + """
, ok AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / av))), 6) AS score
   FROM ix JOIN qt USING (term) JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY 1, 2)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ok QUALIFY rank <= 10""")
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, (pruned.OKAPI, 10)).select("item_id", "doc_id", "score", "rank")


@query("term_hits_top10", _INDEX + "SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM th QUALIFY rank <= 10")
def term_hits_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, (pruned.TERM_HITS, 10)).select("item_id", "doc_id", F.col("score").cast("long").alias("score"), "rank")


#: Every tenth passage against all documents; sources are the metadata.
_SCAN = """
WITH q AS (SELECT item_id, lower(trim(text)) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS terms FROM benchmark WHERE item_id % 10 = 0),
d AS (SELECT doc_id, text, lower(text) AS c, lower(source) AS m FROM documents),
s AS (
  SELECT item_id, doc_id, text, (CASE WHEN q <> '' AND contains(c, q) THEN 40 ELSE 0 END + CASE WHEN q <> '' AND contains(m, q) THEN 20 ELSE 0 END
    + coalesce(list_sum(list_transform(list_filter(terms, lambda t: t <> ''), lambda t: CASE WHEN contains(c, t) THEN 10 + least((length(c) - length(replace(c, t, ''))) // length(t), 5) ELSE 0 END
      + CASE WHEN contains(m, t) THEN 5 + least((length(m) - length(replace(m, t, ''))) // length(t), 3) ELSE 0 END)), 0))::BIGINT AS score FROM q, d)
"""


def _scan(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0")
    return patterns.substring_top_k(table(spark, sf_dir, "documents"), "doc_id", F.lower("text"), F.lower("source"), passages, "item_id", F.lower(F.trim("text")), tx.words(F.col("text")), 10, **more)


@query("substring_score_top10", _SCAN + "SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10")
def substring_score_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).withColumn("score", F.col("score").cast("long"))


@query("chunk_relevance_top10", _SCAN + """
, r AS (SELECT item_id, doc_id, score + CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END - CASE WHEN length(text) > 3000 THEN 0.5 ELSE 0 END AS score FROM s)
SELECT item_id, doc_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0 QUALIFY rank <= 10""")
def chunk_relevance_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an even id stand as nodes."""
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "node:").otherwise("page:"), "doc_id")
    return _scan(spark, sf_dir, bonus=tx.relevance_bonus(F.col("text"), path), flag=F.contains(F.col("text"), F.lit(tx.WHO)), flag_bonus=tx.profile_bonus(F.col("text")))


@query("rrf_two_lists", """
WITH a AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY sum(value) DESC, user_id) AS rank FROM events GROUP BY 1, 2 QUALIFY rank <= 30),
b AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY 1, 2 QUALIFY rank <= 30)
SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.user_id, b.user_id) AS user_id,
       round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 9) AS fused, a.rank AS rank_1, b.rank AS rank_2
FROM a FULL JOIN b ON a.event_type = b.event_type AND a.user_id = b.user_id""")
def rrf_two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    lists = [search.top_k(g, ["event_type"], [F.desc(c), F.asc("user_id")], 30) for c in ("v", "n")]
    return search.fuse(lists, ["event_type", "user_id"])


@query("cross_source_merge", """
WITH r AS (SELECT user_id, event_type, sum(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY sum(value) DESC, user_id) AS rank FROM events GROUP BY 1, 2)
SELECT user_id, round(sum(1 / (60 + rank)), 9) AS fused, min(rank) AS best_rank, round(max(v), 2) AS best_value, string_agg(event_type, ',' ORDER BY event_type) AS profiles
FROM r GROUP BY user_id""")
def cross_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums go in the order of events: users of equal events tie exactly, and the least id comes first."""
    g = search.ordered_sums(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["event_id", "value"], "value", "v")
    ranked = search.top_k(g, ["event_type"], [F.desc("v"), F.asc("user_id")], 2**31 - 1)
    return ranked.groupBy("user_id").agg(
        F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("fused"), F.min("rank").alias("best_rank"), F.round(F.max("v"), 2).alias("best_value"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("profiles"),
    )


@query("doc_coverage_topk", """
WITH s AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) > 1 AS later FROM events)
SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY later, value DESC, event_id) AS rank FROM s QUALIFY rank <= 6""")
def doc_coverage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return search.covered_top_k(events, ["user_id"], "event_type", [F.desc("value"), F.asc("event_id")], 6).select("user_id", "event_type", "event_id", "rank")


@query("category_coverage_topk", """
WITH n AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1),
s AS (SELECT e.user_id, event_type, event_id, value, CASE WHEN n <= 4 THEN row_number() OVER (PARTITION BY e.user_id, event_type ORDER BY value DESC, event_id) > 1 ELSE false END AS later FROM events e JOIN n ON e.user_id = n.user_id)
SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY later, value DESC, event_id) AS rank FROM s QUALIFY rank <= 4""")
def category_coverage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return search.category_top_k(events, ["user_id"], "event_type", [F.desc("value"), F.asc("event_id")], 4).select("user_id", "event_type", "event_id", "rank")


@query("positive_or_all", """
WITH s AS (SELECT s_nationkey, s_suppkey, greatest(s_acctbal - 5000, 0) AS score FROM supplier)
SELECT * FROM s QUALIFY score > 0 OR max(score) OVER (PARTITION BY s_nationkey) <= 0""")
def positive_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.greatest(F.col("s_acctbal") - 5000, F.lit(0.0)).alias("score"))
    return search.positive_or_all(s, ["s_nationkey"], "score")


@query("round_robin_merge", """
WITH t AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS turn FROM events)
SELECT user_id, event_type, event_id, turn, row_number() OVER (PARTITION BY user_id ORDER BY turn, event_type) AS position FROM t""")
def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return search.round_robin(events, ["event_type"], [F.asc("event_id")], ["user_id"])


_GROUPS = [("g1", ["small ring", "economy"]), ("g2", ["red widget", "promo", "brand#17"]), ("g3", ["blue", "bolt"])]


@query("keyword_prefilter", """
WITH g(group_ref, keywords) AS (VALUES ('g1', ['small ring', 'economy']), ('g2', ['red widget', 'promo', 'brand#17']), ('g3', ['blue', 'bolt'])),
p AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type || ' ' || p_brand) AS d FROM part),
k AS (SELECT p_partkey, group_ref, len(keywords) AS nk, n, d, unnest(keywords) AS w FROM p, g),
h AS (SELECT p_partkey, group_ref, nk, contains(w, ' ') AND contains(n, w) AS pn, contains(w, ' ') AND contains(d, w) AS pd,
  contains(n, split_part(w, ' ', 1)) AND contains(n, split_part(w, ' ', -1)) AS cn, contains(d, split_part(w, ' ', 1)) AND contains(d, split_part(w, ' ', -1)) AS cd FROM k)
SELECT p_partkey, group_ref, round(least(1.0, 0.45 * max(pn::INT) + 0.30 * sum(cn::INT) / any_value(nk) + 0.15 * max(pd::INT) + 0.10 * sum(cd::INT) / any_value(nk)), 6) AS score
FROM h GROUP BY 1, 2 HAVING score > 0""")
def keyword_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_brand").alias("about"))
    groups = spark.createDataFrame(_GROUPS, "group_ref string, keywords array<string>")
    return search.keyword_prefilter(parts, groups, "p_name", "about").select("p_partkey", "group_ref", "score")


@query("idf_secondary_prefilter", """
WITH t AS (SELECT p_type AS grp, p_partkey, lower(unnest(string_split(p_name, ' '))) AS term, true AS in_name FROM part UNION ALL SELECT p_type, p_partkey, lower(p_brand), false FROM part),
n AS (SELECT count(*)::DOUBLE AS n FROM part), df AS (SELECT grp, term, count(DISTINCT p_partkey) AS df FROM t GROUP BY 1, 2),
w AS (SELECT grp, term, ln((n + 1) / (df + 1)) / ln(n + 1) AS idf FROM df, n WHERE idf >= 0.35),
s AS (SELECT t.grp, p_partkey, round(sum(idf * CASE WHEN in_name THEN 1.0 ELSE 0.45 END * greatest(0.5, least(1.75, length(t.term) / 4))), 6) AS score FROM t JOIN w ON t.grp = w.grp AND t.term = w.term GROUP BY 1, 2)
SELECT * FROM s QUALIFY score >= 0.6 * max(score) OVER (PARTITION BY grp)""")
def idf_secondary_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_type").alias("grp"), "p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("term"), F.lit(True).alias("in_name"))
    brands = p.select(F.col("p_type").alias("grp"), "p_partkey", F.lower("p_brand").alias("term"), F.lit(False).alias("in_name"))
    return search.informative_prefilter(names.unionByName(brands), p.count(), "grp", "p_partkey")


@query("scarcity_gain", """
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM m GROUP BY 1)
SELECT l_orderkey, round(sum(1 / greatest(n, 1)), 9) AS gain, count(*) AS groups FROM m JOIN n USING (l_suppkey) GROUP BY 1""")
def scarcity_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scarcity(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


@query("duplicate_merge", """
SELECT sha256(text) AS content_key, min(doc_id) AS doc_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, max(n_chars) AS n_chars, count(*) AS copies
FROM documents GROUP BY 1""")
def duplicate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_key")).agg(
        F.min("doc_id").alias("doc_id"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies")
    )


@query("citation_markers", """
WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[0-9]+'))::BIGINT AS n FROM (SELECT conv_id, turn, '[' || (turn + 1) || '] and [' || (conv_id + 9) || ']' AS text FROM conversations)),
t AS (SELECT conv_id, turn + 1 AS n FROM conversations)
SELECT m.conv_id, m.turn, m.n, t.n IS NOT NULL AS valid FROM m LEFT JOIN t ON m.conv_id = t.conv_id AND m.n = t.n""")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    answer = F.concat(F.lit("["), F.col("turn") + 1, F.lit("] and ["), F.col("conv_id") + 9, F.lit("]"))
    markers = c.select("conv_id", "turn", F.explode(F.regexp_extract_all(answer, F.lit("\\[(\\d+)\\]"), F.lit(1)).cast("array<long>")).alias("n"))
    evidence = c.select("conv_id", (F.col("turn") + 1).alias("n"), F.lit(True).alias("hit"))
    return markers.join(evidence, ["conv_id", "n"], "left").select("conv_id", "turn", "n", F.coalesce("hit", F.lit(False)).alias("valid"))


@query("predicate_fusion", """
WITH b AS (SELECT user_id AS predicate, event_id AS unit, value AS lexical, CASE WHEN event_id % 3 > 0 THEN json_extract(props, '$.k')::DOUBLE END AS model, CASE WHEN event_type = 'view' THEN 80.0 ELSE 40.0 END::DOUBLE AS vector, (event_id % 5) / 5 AS grounding FROM events),
m AS (SELECT *, CASE WHEN grounding >= 0.35 THEN model END AS gm FROM b),
k AS (SELECT *, rank() OVER (PARTITION BY predicate ORDER BY lexical DESC) AS rl, CASE WHEN gm IS NOT NULL THEN rank() OVER (PARTITION BY predicate ORDER BY gm DESC NULLS LAST) END AS rm, rank() OVER (PARTITION BY predicate ORDER BY vector DESC) AS rv FROM m),
s AS (SELECT *, round(0.82 * greatest(lexical, coalesce(gm, 0), least(vector, 70)) + 0.18 * least(100, (1 / (60 + rl) + coalesce(1 / (60 + rm), 0) + 1 / (60 + rv)) / (2 + (rm IS NOT NULL)::INT) * 6100), 6) AS score FROM k)
SELECT predicate, unit, score, row_number() OVER (PARTITION BY predicate ORDER BY score DESC, unit) AS rank FROM s WHERE (lexical >= 60 OR gm >= 55) AND score >= 60 QUALIFY rank <= 12""")
def predicate_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("predicate"), F.col("event_id").alias("unit"), F.col("value").alias("lexical"),
        F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k").cast("double")).alias("model"),
        F.when(F.col("event_type") == "view", 80.0).otherwise(40.0).alias("vector"), F.lit(None).cast("double").alias("visual"), ((F.col("event_id") % 5) / 5).alias("grounding"),
    )
    return search.predicate_fusion(rows, "predicate", "unit")
