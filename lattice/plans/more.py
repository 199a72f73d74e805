"""Further operators: shaping of text, table columns, DAG levels, nested trees, queues, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.catalog import table
from lattice.functions import shaping
from lattice.functions import vector as vx
from lattice.operators import folds, trees
from lattice.plans.registry import query


@query("normal_form_terms", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')))::BIGINT AS n_terms FROM documents")
def normal_form_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(shaping.mixed_terms(F.col("text"))).cast("long").alias("n_terms"))


@query("question_parts", """
WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[\\n;；。！？!?]+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM conversations)
SELECT conv_id, turn, len(list_distinct(p))::BIGINT AS n FROM p""")
def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(shaping.question_parts(F.col("text"))).cast("long").alias("n"))


@query("scored_line_split")
def scored_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.posexplode(shaping.split_lines(F.col("text"), 42, 4, 60)).alias("line_no", "line")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lines)


@query("turn_similarity")
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).where("before is not null")
    return pairs.select("conv_id", "turn", shaping.similarity(F.col("before"), F.col("text")).alias("ratio"))


@query("frame_ranges", """
SELECT event_id, round_even(value * 25, 0)::BIGINT AS first_frame, greatest(round_even(value * 25, 0)::BIGINT + 1, round_even((value + 0.5) * 25, 0)::BIGINT) AS end_frame FROM events""")
def frame_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.bround(F.col("value") * 25).cast("long")
    return table(spark, sf_dir, "events").select("event_id", first.alias("first_frame"), F.greatest(first + 1, F.bround((F.col("value") + 0.5) * 25).cast("long")).alias("end_frame"))


@query("paragraph_merge", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT *, coalesce(NOT (NOT regexp_matches(lag(line) OVER w, '[.!?:;。！？]$') AND NOT regexp_matches(line, '^[0-9A-Z]')), true) AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS p FROM f)
SELECT doc_id, p::BIGINT AS paragraph, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM g GROUP BY 1, 2""")
def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    goes_on = ~F.lag("line").over(w).rlike("[.!?:;。！？]$") & ~F.col("line").rlike("^[0-9A-Z]")
    numbered = lines.withColumn("_new", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "paragraph").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("column_bins", """
WITH c AS (SELECT l_orderkey AS page, l_suppkey % 4 AS row_no, floor(l_quantity / 18)::BIGINT AS bin, l_discount < 0.05 AS numeric FROM lineitem),
r AS (SELECT page, row_no FROM c GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT page, bin, count(DISTINCT row_no) AS n, avg(numeric::INT) AS ratio FROM c JOIN r USING (page, row_no) GROUP BY 1, 2)
SELECT page, count(*) FILTER (WHERE n >= 2) AS stable, round(avg(ratio), 6) AS numeric_ratio, count(*) FILTER (WHERE n >= 2) >= 2 AS is_table FROM b GROUP BY 1""")
def column_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 4).alias("row_no"), F.floor(F.col("l_quantity") / 18).alias("bin"), (F.col("l_discount") < 0.05).cast("int").alias("numeric"))
    wide = cells.groupBy("page", "row_no").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    bins = cells.join(wide, ["page", "row_no"]).groupBy("page", "bin").agg(F.count_distinct("row_no").alias("n"), F.avg("numeric").alias("ratio"))
    stable = F.count_if(F.col("n") >= 2)
    return bins.groupBy("page").agg(stable.alias("stable"), F.round(F.avg("ratio"), 6).alias("numeric_ratio"), (stable >= 2).alias("is_table"))


@query("title_page_match", """
WITH t AS (SELECT p_brand, p_name, p_type, min(p_size) AS printed FROM part GROUP BY 1, 2, 3)
SELECT p.p_partkey, t.printed, p.p_size AS physical, p.p_size - t.printed AS "offset" FROM part p JOIN t ON p.p_brand = t.p_brand AND p.p_name = t.p_name AND p.p_type = t.p_type WHERE p.p_size >= t.printed + 1""")
def title_page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    title = ["p_brand", "p_name", "p_type"]
    toc = p.groupBy(*title).agg(F.min("p_size").alias("printed"))
    j = p.join(toc, title).where(F.col("p_size") >= F.col("printed") + 1)
    return j.select("p_partkey", "printed", F.col("p_size").alias("physical"), (F.col("p_size") - F.col("printed")).alias("offset"))


@query("adjacent_page_pairs", """
SELECT conv_id, turn - 1 AS first_page, turn AS second_page FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
WHERE b = turn - 1 AND abs(n - length(text)) < 0.5 * greatest(n, length(text))""")
def adjacent_page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"), F.lag("turn").over(w).alias("b"), F.lag(n).over(w).alias("m"))
    return rows.where((F.col("b") == F.col("turn") - 1) & (F.abs(F.col("m") - F.col("n")) < 0.5 * F.greatest("m", "n"))).select("conv_id", (F.col("turn") - 1).alias("first_page"), F.col("turn").alias("second_page"))


_MATRIX = """
SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id"""


@query("similarity_matrix", _MATRIX)
@query("similarity_matrix_all", _MATRIX)
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of each id to all others of its group."""
    from lattice.operators.vectors import pair_cosines

    return pair_cosines(table(spark, sf_dir, "embeddings"), "label")


@query("weighted_importance", """
SELECT user_id, round(0.35 * least(1, max(value) / 100) + 0.35 * (0.8 * avg(value) / 100 + 0.2 * least(1, (epoch(max(ts)) - epoch(min(ts))) / 2678400)) + 0.30 * count(DISTINCT event_type) / 5, 6) AS importance FROM events GROUP BY 1""")
def weighted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    score = 0.35 * F.least(F.lit(1.0), F.max("value") / 100) + 0.35 * (0.8 * F.avg("value") / 100 + 0.2 * F.least(F.lit(1.0), (F.max(t) - F.min(t)) / 2678400)) + 0.30 * F.count_distinct("event_type") / 5
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(score, 6).alias("importance"))


@query("tree_rebuild_flatten", """
SELECT r_regionkey, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS sibling_order, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey""")
def tree_rebuild_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children gathered under their parents in order, then flattened to rows again."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nodes"))
    nested = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "nodes")
    return nested.select("r_regionkey", F.posexplode("nodes").alias("sibling_order", "node")).select("r_regionkey", "node.n_nationkey", F.col("sibling_order").cast("long").alias("sibling_order"), F.col("node.n_name").alias("title"))


@query("nested_trees", """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
k AS (SELECT * FROM e WHERE event_type <> 'error'),
r AS (
  SELECT user_id, i, event_type, 1 AS level FROM k WHERE i <= 2
  UNION ALL SELECT k.user_id, k.i, k.event_type, r.level + 1 FROM r JOIN k ON k.user_id = r.user_id AND k.i // 3 = r.i AND k.i > 2),
c AS (SELECT user_id, i // 3 AS p, count(*) AS n FROM r WHERE i > 2 GROUP BY 1, 2)
SELECT r.user_id, r.i::VARCHAR AS node_id, CASE WHEN r.i > 2 THEN (r.i // 3)::VARCHAR END AS parent_node_id, row_number() OVER (PARTITION BY r.user_id, CASE WHEN r.i > 2 THEN r.i // 3 END ORDER BY r.i) - 1 AS sibling_order,
  r.level, coalesce(c.n, 0) AS child_count, r.event_type AS title
FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.p = r.i""")
def nested_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a tree of three children a node, without those of one type (what hangs below them vanishes), nested and flattened again."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", i.alias("i"), "event_type").where("event_type != 'error'")
    nodes = rows.select("user_id", F.col("i").cast("string").alias("node_id"), F.when(F.col("i") > 2, F.floor(F.col("i") / 3).cast("string")).alias("parent_node_id"), F.col("i").alias("sibling_order"), F.col("event_type").alias("title"))
    back = trees.flattened(trees.nested(nodes, "user_id", ["title"]), "user_id", "structure", "title string")
    return back.select("user_id", "node_id", "parent_node_id", F.col("sibling_order").cast("long").alias("sibling_order"), F.col("level").cast("long").alias("level"), F.col("child_count").cast("long").alias("child_count"), "title")


@query("dag_levels", """
WITH RECURSIVE e AS (SELECT n_nationkey AS node, n_nationkey // 2 AS needs FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, n_nationkey // 3 FROM nation WHERE n_nationkey > 2),
w AS (SELECT n_nationkey AS node, 0 AS depth FROM nation WHERE n_nationkey NOT IN (SELECT node FROM e) UNION SELECT e.node, depth + 1 FROM w JOIN e ON e.needs = w.node)
SELECT node, max(depth) AS level FROM w GROUP BY 1""")
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest path from a step without needs."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("node"))
    e = n.where("node > 0").select("node", F.floor(F.col("node") / 2).cast("int").alias("needs")).union(n.where("node > 2").select("node", F.floor(F.col("node") / 3).cast("int"))).distinct()
    return trees.levels(n, e)


@query("response_accumulation", """
SELECT conv_id, count(*) AS deltas, md5(string_agg(text, '' ORDER BY turn)) AS digest, sum(length(text))::BIGINT AS chars FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def response_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("deltas"), F.md5(F.array_join(parts, "")).alias("digest"), F.sum(F.length("text")).alias("chars"))


@query("fair_queue_positions", """
WITH t AS (SELECT user_id, event_id, ts, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY date_trunc('day', ts), user_id ORDER BY ts, event_id) AS turn FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY day ORDER BY turn, user_id) AS position FROM t""")
def fair_queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.operators.search import round_robin

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"))
    return round_robin(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], ["day"]).select("user_id", "event_id", "position")


@query("compare_and_set_claim", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'running' ELSE o_orderstatus END AS status, o_orderstatus IN ('O', 'P') AS claimed FROM orders""")
def compare_and_set_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = F.col("o_orderstatus").isin("O", "P")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(free, "running").otherwise(F.col("o_orderstatus")).alias("status"), free.alias("claimed"))


@query("drop_priority_trim")
def drop_priority_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order within a budget of 100; kinds R go first, then A, then N, each from its end."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("long").alias("size"))

    def decide(kinds: list[str], sizes: list[int]) -> list[bool]:
        kept, used = [True] * len(sizes), sum(sizes)
        for kind in ("R", "A", "N"):
            for i in reversed(range(len(sizes))):
                if used > 100 and kept[i] and kinds[i] == kind:
                    kept[i], used = False, used - sizes[i]
        return kept

    return folds.fold_column(li, ["l_orderkey"], ["l_linenumber", "size"], ["kind", "size"], decide, "kept", T.BooleanType())


@query("kmeans_pick")
def kmeans_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector nearest to each of eight centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=8, seed=0, maxIter=20).fit(v)
    centres = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()))
    near = model.transform(v).select("vec_id", F.col("prediction").alias("cluster"), vx.dot(F.col("embedding"), F.get(centres, F.col("prediction"))).alias("score"))
    return near.groupBy("cluster").agg(F.max_by("vec_id", F.struct(F.round("score", 9), -F.col("vec_id"))).alias("vec_id"))


@query("output_names", "SELECT p_partkey, regexp_replace(p_name || '_' || p_brand || '_v' || p_size, '[^A-Za-z0-9_.-]+', '-', 'g') || '.mp4' AS file_name FROM part")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", shaping.output_name([F.col("p_name"), F.col("p_brand"), F.concat(F.lit("v"), F.col("p_size").cast("string"))], ".mp4").alias("file_name"))


#: Patterns of a question with their weights, by workflow.
_INTENTS = {"report": ((r"(?i)report|overview", 3), (r"(?i)\bthe\b", 1)), "search": ((r"(?i)token|und ", 2), (r"\?", 1)), "chat": ((r"(?i)^(hi|hello)\b", 5),)}


@query("intent_rules", """
WITH s AS (SELECT conv_id, turn, 3 * regexp_matches(text, '(?i)report|overview')::INT + regexp_matches(text, '(?i)\\bthe\\b')::INT AS r, 2 * regexp_matches(text, '(?i)token|und ')::INT + regexp_matches(text, '\\?')::INT AS s, 5 * regexp_matches(text, '(?i)^(hi|hello)\\b')::INT AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN greatest(r, s, c) = 0 THEN 'other' WHEN r = greatest(r, s, c) THEN 'report' WHEN s = greatest(r, s, c) THEN 'search' ELSE 'chat' END AS intent FROM s""")
def intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", shaping.intent(F.col("text"), _INTENTS, "other").alias("intent"))


@query("line_clusters")
def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page grouped to lines by vertical overlap."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("top"), (F.col("l_discount") * 100 + F.col("l_tax") * 50 + 1).alias("bottom"))
    decide = lambda top, bottom: folds.text_lines(list(zip(top, bottom, strict=True)))
    return folds.fold_column(li, ["l_orderkey"], ["l_linenumber", "top", "bottom"], ["top", "bottom"], decide, "line", T.LongType()).select("l_orderkey", "l_linenumber", "line")


@query("optional_expansion")
def optional_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parts that fill the rest of an order's budget, new suppliers first."""
    w = Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", F.col("l_quantity").cast("long"), "l_discount")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) > 1).alias("covered"), F.col("l_discount").alias("score"), F.col("l_quantity").cast("long").alias("size"))
    decide = lambda covered, score, size: folds.expand_optional(covered, score, size, 90, 0.02)
    return folds.fold_column(li, ["l_orderkey"], ["l_linenumber", "size", "score"], ["covered", "score", "size"], decide, "taken", T.BooleanType()).select("l_orderkey", "l_linenumber", "taken")
