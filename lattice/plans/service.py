"""Requests, caches, reading plans and layout: what a service around the tables decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.catalog import table
from lattice.functions import shaping
from lattice.functions import text as tx
from lattice.operators import direct, folds, reduction, rules, service, tables
from lattice.plans.registry import query


@query("request_validation", """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'keyword' ELSE 'hybrid' END AS mode, o_custkey % 60 AS top_k, o_orderkey % 600 AS n, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice::BIGINT // 8 END AS tokens FROM orders)
SELECT o_orderkey, CASE WHEN mode = 'keyword' THEN 501 WHEN top_k > 50 OR n > 500 OR coalesce(nullif(tokens, 0), 8000) NOT BETWEEN 500 AND 32000 THEN 422 END AS status,
  CASE WHEN mode = 'keyword' THEN 'MODE_NOT_IMPLEMENTED' WHEN top_k > 50 THEN 'INVALID_TOP_K' WHEN n > 500 THEN 'TOO_MANY_DOCUMENT_IDS' WHEN coalesce(nullif(tokens, 0), 8000) NOT BETWEEN 500 AND 32000 THEN 'INVALID_RETURN_TOKEN_BUDGET' END AS code FROM r""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    mode = F.when(F.col("o_orderstatus") == "P", "keyword").otherwise("hybrid")
    tokens = F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.round("o_totalprice") / 8).cast("long"))
    error = service.request_error(mode, F.col("o_custkey") % 60, F.col("o_orderkey") % 600, tokens)
    return o.select("o_orderkey", error.alias("e")).select("o_orderkey", "e.status", "e.code")


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.col("user_id").cast("string").alias("k"), t.alias("t"), (F.col("value") * 60).alias("d"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"))


@query("cache_lru_hits", """
WITH e AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
l AS (SELECT *, lag(rn) OVER (PARTITION BY event_type, user_id ORDER BY rn) AS before FROM e)
SELECT a.event_type, a.event_id, a.before IS NOT NULL AND (SELECT count(DISTINCT b.user_id) FROM e b WHERE b.event_type = a.event_type AND b.rn > a.before AND b.rn < a.rn) < 16 AS hit FROM l a""")
def cache_lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache of 16 users for each event type."""
    return folds.fold_column(_lookups(spark, sf_dir), ["event_type"], ["t", "event_id"], ["t", "k"], lambda t, k: service.cache_hits(t, k, 16), "hit", T.BooleanType()).select("event_type", "event_id", "hit")


@query("cache_ttl_hits", """
WITH RECURSIVE e AS (SELECT event_type, event_id, user_id, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (
  SELECT event_type, event_id, user_id, rn, false AS hit, t AS stored FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_type, e.event_id, e.user_id, e.rn, e.t <= f.stored + 259200, CASE WHEN e.t <= f.stored + 259200 THEN f.stored ELSE e.t END FROM f JOIN e ON e.event_type = f.event_type AND e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT event_type, event_id, hit FROM f""")
def cache_ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that live three days, one cache entry for each event type and user."""
    return folds.fold_column(_lookups(spark, sf_dir), ["event_type", "k"], ["t", "event_id"], ["t", "k"], lambda t, k: service.cache_hits(t, k, 1, 259200), "hit", T.BooleanType()).select("event_type", "event_id", "hit")


@query("admission_outcomes")
def admission_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type and day is one service with 2 slots and 3 places to wait for 20 minutes."""
    kind = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("start", T.DoubleType())])
    decide = lambda t, user, d: [{"outcome": o, "start": s} for o, s in service.admissions(t, user, d, 2, 3, 1200)]
    out = folds.fold_column(_lookups(spark, sf_dir), ["event_type", "day"], ["t", "event_id"], ["t", "k", "d"], decide, "r", kind)
    return out.select("event_type", "event_id", "r.*")


@query("page_reading_plan", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
p AS (SELECT doc_id, (pos // 4)::BIGINT AS page, sum(length(line))::BIGINT AS n FROM l GROUP BY 1, 2),
s AS (SELECT doc_id, page // 3 AS k, min(page) AS a, max(page) AS b FROM p WHERE page < 9 GROUP BY 1, 2),
x AS (SELECT p.*, EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND s.k = 0 AND p.page BETWEEN s.a AND s.b) AS gone FROM p),
y AS (SELECT *, min(gone::INT) OVER (PARTITION BY doc_id) = 1 AS whole FROM x), z AS (SELECT * FROM y WHERE NOT gone OR whole),
f AS (SELECT z.doc_id, s.a, min(z.page) AS page FROM z JOIN s ON s.doc_id = z.doc_id AND z.page BETWEEN s.a AND s.b GROUP BY 1, 2),
g AS (SELECT z.doc_id, z.page, n, f.a, sum(ceil(n / 4) + 16) OVER (PARTITION BY z.doc_id) <= 900 AS fits, max(f.a) OVER (PARTITION BY z.doc_id) IS NOT NULL AS any_section,
  count(*) OVER (PARTITION BY z.doc_id) AS c, row_number() OVER (PARTITION BY z.doc_id ORDER BY z.page) - 1 AS i FROM z LEFT JOIN f ON f.doc_id = z.doc_id AND f.page = z.page),
h AS (SELECT *, CASE WHEN any_section THEN a IS NOT NULL ELSE c <= 4 OR i IN (0, round_even((c - 1) / 3, 0)::INT, round_even(2 * (c - 1) / 3, 0)::INT, c - 1) END AS lead FROM g)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN fits OR lead THEN 0 ELSE 1 END, CASE WHEN fits THEN 0 WHEN lead THEN coalesce(a, 0) ELSE -(n % 97) END, page) AS rank FROM h""")
def page_reading_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four lines; the first nine pages make sections of three, the first of which is a table of contents."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    pages = lines.groupBy("doc_id", F.floor(F.col("pos") / 4).alias("page")).agg(F.sum(F.length("line")).alias("n"))
    sections = pages.where("page < 9").groupBy("doc_id", F.floor(F.col("page") / 3).alias("k")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    titled = sections.withColumn("title", F.when(F.col("k") == 0, " Contents ").otherwise("part"))
    return service.page_plan(pages, titled, F.col("n") % 97, F.ceil(F.col("n") / 4) + 16, 900, ("contents", "references"))


@query("continued_tables", """
WITH t AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS position, l_discount * 100 AS w, l_suppkey % 3 AS columns, l_returnflag AS a, l_linestatus AS b, l_tax < 0.02 AS captioned, (l_tax > 0.07)::INT AS notes FROM lineitem),
p AS (SELECT *, lag(w) OVER o AS pw, lag(columns) OVER o AS pc, lag(a) OVER o AS pa, lag(b) OVER o AS pb, lag(notes) OVER o AS pn, lag(position) OVER o AS pp FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY position)),
g AS (SELECT *, coalesce(NOT captioned AND pn = 0 AND abs(pw - w) < 0.1 * least(100 + pw, 100 + w) AND (pc = columns OR 1 = 2), false) AS goes FROM p)
SELECT doc_id, position, sum((NOT goes)::INT) OVER (PARTITION BY doc_id ORDER BY position)::BIGINT AS chain, CASE WHEN NOT goes THEN 0 WHEN a = pa AND b = pb THEN 2 WHEN a = pa THEN 1 ELSE 0 END AS skip FROM g""")
def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as tables on pages one after the other."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    tables = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("position"), F.row_number().over(w).alias("page"), F.lit(0.0).alias("x0"), (100 + F.col("l_discount") * 100).alias("x1"), (F.col("l_suppkey") % 3).alias("columns"),
        F.array(F.array("l_returnflag", F.lit("h")), F.array("l_linestatus")).alias("rows"), F.when(F.col("l_tax") < 0.02, "Table").alias("caption"), (F.col("l_tax") > 0.07).cast("int").alias("footnotes"),
    )
    return service.continued_tables(tables).withColumn("chain", F.col("chain").cast("long"))


@query("joined_tables", """
WITH t AS (SELECT l_orderkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
SELECT l_orderkey AS doc_id, 1::BIGINT AS position, max(n) AS last_position, count(*) + 1 AS n_rows,
  '<table><tr><th>Line</th><th>Flag</th></tr>' || string_agg('<tr>' || CASE WHEN n % 2 = 1 THEN '<td rowspan="2">' || n || '</td>' ELSE '' END || '<td>' || f || '</td></tr>', '' ORDER BY n) || '</table>' AS html
FROM t GROUP BY 1""")
def joined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order as a table on a page of its own under a repeated header; the cell of every odd line spans the page break."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("position"), "l_returnflag")
    first = F.when(F.col("position") % 2 == 1, F.concat(F.lit('<td rowspan="2">'), F.col("position").cast("string"), F.lit("</td>"))).otherwise("")
    html = F.concat(F.lit("<table><tr><th>Line</th><th>Flag</th></tr><tr>"), first, F.lit("<td>"), "l_returnflag", F.lit("</td></tr></table>"))
    pages = lines.select("doc_id", "position", F.col("position").alias("page"), F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"), html.alias("html"), F.lit(None).cast("string").alias("caption"), F.lit(0).alias("footnotes"))
    return tables.joined_tables(pages)


@query("reading_order")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page in the order of recursive cuts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 4).alias("x0"), (F.col("l_discount") * 1000).alias("y0"), (F.col("l_quantity") * 4 + 30).alias("x1"), (F.col("l_discount") * 1000 + 15).alias("y1"))

    def decide(x0: list, y0: list, x1: list, y1: list) -> list[int]:
        place = [0] * len(x0)
        for n, i in enumerate(folds.xy_cut(list(zip(x0, y0, x1, y1, strict=True)))):
            place[i] = n
        return place

    return folds.fold_column(li, ["l_orderkey"], ["l_linenumber", "x0", "y0"], ["x0", "y0", "x1", "y1"], decide, "place", T.LongType()).select("l_orderkey", "l_linenumber", "place")


@query("depth_capped_tree", "SELECT conv_id, turn, CASE WHEN row_number() OVER w = 1 THEN NULL WHEN row_number() OVER w = 2 THEN 0 ELSE 1 END AS parent FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def depth_capped_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a chain, cut to three levels: all deeper turns hang below the second."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 2).alias("up"))
    decide = lambda up: rules.capped_parents([None if u < 0 else u for u in up], 3)
    return folds.fold_column(rows, ["conv_id"], ["turn"], ["up"], decide, "parent", T.LongType()).select("conv_id", "turn", "parent")


@query("paced_cues")
def paced_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues of four seconds, read at 30 characters a second at most: start, end and cue of each turn."""
    start = F.col("turn") * 4.0
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", start.alias("s"), (start + 3.5).alias("e"))
    kind = T.StructType([T.StructField("cue", T.LongType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])

    def decide(texts: list[str], s: list[float], e: list[float]) -> list[dict]:
        out: list[dict] = [{}] * len(s)
        for n, (a, b, members) in enumerate(rules.paced(texts, s, e, 30.0)):
            for m in members:
                out[m] = {"cue": n, "start": a, "end": b}
        return out

    return folds.fold_column(rows, ["conv_id"], ["turn"], ["text", "s", "e"], decide, "r", kind).select("conv_id", "turn", "r.*")


@query("query_term_sets", """
WITH t AS (SELECT doc_id, list_distinct(list_concat(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x <> ''), ['检索系统', '检索', '索系', '系统', '检索系', '索系统'])) AS t FROM documents)
SELECT doc_id, len(t) AS n_terms, list_min(t) AS first_term, len(list_filter(t, lambda x: length(x) = 2)) AS n_pairs FROM t""")
def query_term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query terms of every document with runs of ideographs behind it, stop words among them."""
    t = table(spark, sf_dir, "documents").select("doc_id", tx.query_terms(F.concat("text", F.lit(" 请问 检索系统 什么"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.element_at("t", 1).alias("first_term"), F.size(F.filter("t", lambda x: F.length(x) == 2)).cast("long").alias("n_pairs"))


@query("bigram_index", """
WITH t AS (SELECT conv_id, turn, list_concat(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x <> ''), ['索引', '引擎', '库']) AS t FROM conversations), u AS (SELECT conv_id, turn, unnest(t) AS term FROM t)
SELECT conv_id, term, count(*) AS tf FROM u GROUP BY 1, 2""")
def bigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", F.explode(tx.bigram_terms(F.concat("text", F.lit(" 索引擎 库")))).alias("term"))
    return t.where("term != ''").groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query("bigram_coverage", """
WITH c AS (SELECT conv_id, turn, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM conversations),
g AS (SELECT list_distinct(list_transform(range(1, 12), lambda i: substr('thequestions', i, 2))) AS g)
SELECT conv_id, turn, CASE WHEN contains(t, 'thequestions') THEN 98.0 ELSE least(92.0, round_even(len(list_filter(g, lambda x: contains(t, x))) / len(g) * 100, 1)) END::DOUBLE AS relevance FROM c, g""")
def bigram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.coverage_relevance(F.col("text"), F.lit("the questions")).alias("relevance"))


@query("width_and_cells", """
SELECT conv_id, turn, text || '|A9! ' AS half, trim(regexp_replace(replace(text || '|x', '|', '\\|'), '\\s*\\n\\s*', ' ', 'g')) AS cell FROM conversations""")
def width_and_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width forms folded, and texts as cells of a Markdown table."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.half_width(F.concat("text", F.lit("｜Ａ９！　"))).alias("half"), tx.escape_cell(F.concat("text", F.lit("|x"))).alias("cell"))


@query("term_set_algebra", """
WITH d AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS t FROM conversations), q AS (SELECT ['the', 'und', 'que', 'les', 'zzz'] AS q)
SELECT conv_id, turn, len(list_intersect(t, q)) / len(q) AS coverage, len(list_intersect(t, q)) = 0 AS disjoint, len(t) - len(list_intersect(t, q)) AS n_rest FROM d, q""")
def term_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*map(F.lit, ("the", "und", "que", "les", "zzz")))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("t"))
    return t.select("conv_id", "turn", (F.size(F.array_intersect("t", q)) / F.size(q)).alias("coverage"), (~F.arrays_overlap("t", q)).alias("disjoint"), F.size(F.array_except("t", q)).cast("long").alias("n_rest"))


@query("answers_as_json", """
SELECT event_id, props AS found, json_extract_string(props, '$.k') AS k FROM events""")
def answers_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects inside fenced answers with a trailing comma."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", "\\}$", ",}"), F.lit("\n```"))
    found = shaping.tolerant_json(answer)
    return table(spark, sf_dir, "events").select("event_id", found.alias("found")).select("event_id", "found", F.get_json_object("found", "$.k").alias("k"))


@query("dense_passages")
def dense_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as vectors of at most 16 axes."""
    return reduction.char_svd(table(spark, sf_dir, "benchmark"), "item_id", "text", 16, 5000)


@query("direct_pages", """
WITH q AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 = 0),
w AS (SELECT DISTINCT conv_id AS doc_id, page FROM (SELECT conv_id, unnest([2, 0, -1, 2, 99, conv_id % 5 + 1]) AS page FROM q) WHERE page > 0)
SELECT w.doc_id, w.page, c.text AS content, c.conv_id IS NOT NULL AS found FROM w LEFT JOIN conversations c ON c.conv_id = w.doc_id AND c.turn + 1 = w.page""")
def direct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages; some numbers are no pages, repeated or not there."""
    c = table(spark, sf_dir, "conversations")
    stored = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("long").alias("page"), F.col("text").alias("content"))
    asked = c.where("conv_id % 10 = 0").select(F.col("conv_id").alias("doc_id")).distinct().withColumn("pages", F.array(*(F.lit(n).cast("long") for n in (2, 0, -1, 2, 99)), F.col("doc_id") % 5 + 1))
    return direct.pages(asked, stored)


@query("direct_metadata", """
WITH q AS (SELECT c_custkey AS group_ref, unnest([c_custkey, c_custkey + 1, c_custkey * 7]) AS doc_id FROM customer WHERE c_custkey % 3 = 0),
j AS (SELECT group_ref, q.doc_id, o_orderkey, o_orderstatus FROM (SELECT DISTINCT * FROM q) q LEFT JOIN orders ON o_orderkey = q.doc_id)
SELECT group_ref, '[' || coalesce(string_agg('{"doc_name":"order ' || o_orderkey || '","status":"' || o_orderstatus || '"}', ',' ORDER BY doc_id) FILTER (WHERE o_orderkey IS NOT NULL), '') || ']' AS entries,
  coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE o_orderkey IS NULL), '') AS missing FROM j GROUP BY 1""")
def direct_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(k.alias("group_ref"), F.array(k, k + 1, k * 7).alias("doc_ids"))
    profiles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("doc_name"), F.col("o_orderstatus").alias("status"))
    found = direct.metadata(asked, profiles, ["doc_name", "status"])
    return found.select("group_ref", "entries", F.array_join(F.transform("missing", lambda i: i.cast("string")), ",").alias("missing"))


@query("insertion_plan", """
WITH RECURSIVE p AS (SELECT user_id, event_id, event_id % 9 AS image_id, event_type AS section, value > 20 AS topic, event_id % 9 < 7 AS known, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (
  SELECT user_id, i, event_id, image_id, section, topic AND known AS accepted, CASE WHEN topic AND known THEN [image_id] ELSE [] END AS ui, CASE WHEN topic AND known THEN [section] ELSE [] END AS us FROM p WHERE i = 1
  UNION ALL
  SELECT user_id, i, event_id, image_id, section, ok, CASE WHEN ok THEN list_append(ui, image_id) ELSE ui END, CASE WHEN ok THEN list_append(us, section) ELSE us END
  FROM (SELECT p.*, r.ui, r.us, p.topic AND p.known AND NOT list_contains(r.ui, p.image_id) AND NOT list_contains(r.us, p.section) AS ok FROM r JOIN p ON p.user_id = r.user_id AND p.i = r.i + 1))
SELECT user_id, event_id, image_id, section, accepted FROM r""")
def insertion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as proposals: an image for each type of event, where the value gives a topic and the image is known."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 9).alias("image_id"), F.col("event_type").alias("section"), F.when(F.col("value") > 20, "topic").alias("topic"))
    return direct.insertion_plan(e, e.where("image_id < 7"), "user_id", "event_id")
