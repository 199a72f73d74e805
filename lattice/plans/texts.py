"""Text operators over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.catalog import table
from lattice.functions import text as tx
from lattice.functions import tokens
from lattice.plans.registry import query
from lattice.sources import pdf


@query("exact_dedup_sha256", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY digest")
def exact_dedup_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("uuid5_doc_id", """
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('sha256:' || sha256(text))::BLOB) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def uuid5_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.uuid5_of_sha256(F.col("text")).alias("uuid"))


@query("line_pages_120", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, (n - 1) // 120 + 1 AS page, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM l GROUP BY 1, 2""")
def line_pages_120(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.groupBy("doc_id", (F.floor(F.col("pos") / 120) + 1).alias("page")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("overlapping_page_windows", """
WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), p AS (SELECT doc_id, (n - 1) // 20 + 1 AS pages FROM l)
SELECT doc_id, g AS first_page, least(g + 1, pages) AS last_page FROM p, LATERAL (SELECT unnest(generate_series(1, greatest(pages - 1, 1))) AS g)""")
def overlapping_page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", (F.floor((F.size(F.split("text", "\n")) - 1) / 20) + 1).alias("pages"))
    return pages.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("pages") - 1, F.lit(1)))).alias("first_page"), "pages").select(
        "doc_id", "first_page", F.least(F.col("first_page") + 1, F.col("pages")).alias("last_page")
    )


@query("sentence_split", """
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([。！？；.!?;])', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
t AS (SELECT doc_id, regexp_replace(s, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS s FROM s)
SELECT doc_id, count(*) AS n, max(length(s)) AS longest, sum(length(s))::BIGINT AS total FROM t WHERE s <> '' GROUP BY 1""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).cast("long").alias("longest"), F.sum(F.length("s")).alias("total"))


@query("text_quality_flags", """
WITH c AS (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '[[:punct:]]', '', 'g')) AS punct,
  length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper,
  length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) AS control FROM documents)
SELECT *, n >= 100 AND punct >= 0.25 * n AS odd_punctuation, n >= 300 AND control >= 0.03 * n AS garbled, n < 50 AS sparse FROM c""")
def text_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    without = lambda p: (F.length(t) - F.length(F.regexp_replace(t, p, ""))).cast("long")
    c = table(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).cast("long").alias("n"), without("[!-/:-@\\[-`{-~]").alias("punct"), without("[0-9]").alias("digits"), without("[A-Z]").alias("upper"),
        without("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]").alias("control"),
    )
    n = F.col("n")
    return c.select("*", ((n >= 100) & (F.col("punct") >= 0.25 * n)).alias("odd_punctuation"), ((n >= 300) & (F.col("control") >= 0.03 * n)).alias("garbled"), (n < 50).alias("sparse"))


@query("html_strip_text", """
WITH a AS (SELECT page_id, regexp_replace(html, '<!--.*?-->', ' ', 'gs') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '<(script|style)\\b.*?</(script|style)>', ' ', 'gis') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '<[^>]*>', ' ', 'gs') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM c)
SELECT page_id, trim(regexp_replace(t, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM d""")
def html_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("html_url_parts", """
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, url LIKE 'http://%' OR url LIKE 'https://%' AS valid FROM pages""")
def html_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(u, F.lit("HOST")).alias("host"), F.parse_url(u, F.lit("PATH")).alias("path"),
        (u.startswith("http://") | u.startswith("https://")).alias("valid"),
    )


@query("heading_candidates", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, n AS line_no, line FROM l WHERE length(trim(line)) BETWEEN 1 AND 40 AND NOT contains(line, '|') AND NOT contains(line, '://')
  AND NOT regexp_matches(trim(line), '[。！？；.!?;:,]$') AND NOT regexp_matches(trim(line), '^[0-9.]+$')""")
def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    t = F.trim("line")
    keep = F.length(t).between(1, 40) & ~F.contains("line", F.lit("|")) & ~F.contains("line", F.lit("://")) & ~t.rlike("[。！？；.!?;:,]$") & ~t.rlike("^[0-9.]+$")
    return lines.where(keep).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


@query("top_tokens_per_source", """
WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents), c AS (SELECT source, term, count(*) AS n FROM t GROUP BY 1, 2)
SELECT source, term, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 24""")
def top_tokens_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select("source", F.explode(tx.words(F.col("text"))).alias("term"))
    counts = terms.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 24")


@query("material_size", """
SELECT source, sum(length(text))::BIGINT AS chars, sum(greatest(ceil(length(text) / 4), ceil(strlen(text) / 3)))::BIGINT AS tokens FROM documents GROUP BY source""")
def material_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.sum(tx.material_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("token_count_fallback", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS n_tokens FROM documents")
def token_count_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("n_tokens"))


def _ranks() -> dict[bytes, int]:
    import public_tokenizers

    return tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", _ranks())


@query("token_windows")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most 512 tokens, a tenth of each repeated in the next."""
    return tokens.token_windows(table(spark, sf_dir, "documents"), "doc_id", "text", _ranks(), 512)


@query("char_windows_overlap", """
WITH w AS (SELECT doc_id, text, unnest(generate_series(1, greatest(length(text) - 200, 1), 1800)) AS s FROM documents)
SELECT doc_id, s AS start, length(substr(text, s, 2000)) AS n, md5(substr(text, s, 2000)) AS digest FROM w""")
def char_windows_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - 200, F.lit(1)), F.lit(1800))).alias("start"))
    part = F.substring("text", F.col("start"), F.lit(2000))
    return docs.select("doc_id", F.col("start").cast("long").alias("start"), F.length(part).cast("long").alias("n"), F.md5(part).alias("digest"))


@query("loose_source_key", "SELECT source, regexp_replace(lower(source || ' (A-B)_.x'), '[\\s._\\-()\\[\\]]+', '', 'g') AS k, count(*) AS n FROM documents GROUP BY 1")
def loose_source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", tx.loose(F.concat("source", F.lit(" (A-B)_.x"))).alias("k"), "n")


@query("evidence_quote", """
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS t FROM documents),
a AS (SELECT doc_id, t, CASE WHEN contains(lower(t), 'token') THEN strpos(lower(t), 'token') WHEN contains(lower(t), 'lich') THEN strpos(lower(t), 'lich') WHEN contains(lower(t), 'tion') THEN strpos(lower(t), 'tion') ELSE 1 END AS at0 FROM t),
b AS (SELECT doc_id, t, greatest(1, at0 - 80) AS s FROM a)
SELECT doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || substr(t, s, 160) || CASE WHEN s + 159 < length(t) THEN '…' ELSE '' END AS quote FROM b""")
def evidence_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.quote_window(F.col("text"), F.array(F.lit("token"), F.lit("lich"), F.lit("tion"))).alias("quote"))


@query("number_literals", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'))), ',') AS numbers FROM documents")
def number_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.number_literals(F.col("text")), ",").alias("numbers"))


@query("page_expression", """
WITH e AS (SELECT o_orderkey, [o_orderkey % 7 + 1, o_orderkey % 5 + 2] AS r, o_orderkey % 11 + 1 AS s FROM orders),
x AS (SELECT o_orderkey, unnest(list_concat(generate_series(least(r[1], r[2]), greatest(r[1], r[2])), [s])) AS p FROM e)
SELECT o_orderkey, string_agg(p::VARCHAR, ',' ORDER BY p) AS pages FROM (SELECT DISTINCT o_orderkey, p, dense_rank() OVER (PARTITION BY o_orderkey ORDER BY p) AS rk FROM x) WHERE rk <= 4 GROUP BY 1""")
def page_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    expr = F.concat((k % 7 + 1).cast("string"), F.lit("-"), (k % 5 + 2).cast("string"), F.lit(", "), (k % 11 + 1).cast("string"), F.lit(",x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.capped_pages(expr, 4).alias("pages"))


@query("subtitle_clock", """
WITH m AS (SELECT event_id, round_even(value * 1000, 0)::BIGINT AS ms FROM events)
SELECT event_id, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock FROM m""")
def subtitle_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.subtitle_time(F.col("value")).alias("clock"))


@query("stop_word_language", """
WITH t AS (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿ]+')) AS w FROM documents),
c AS (SELECT doc_id, lang, count(*) FILTER (WHERE w IN ('der','die','und','das','ist','nicht','den','zu','mit','von')) AS de, count(*) FILTER (WHERE w IN ('the','and','of','to','in','is','that','for','with','as')) AS en,
  count(*) FILTER (WHERE w IN ('el','los','que','en','del','las','por','con','una','se')) AS es, count(*) FILTER (WHERE w IN ('le','les','et','des','est','la','une','dans','pour','du')) AS fr FROM t GROUP BY 1, 2)
SELECT doc_id, lang, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'und' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS guess FROM c""")
def stop_word_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", tx.stop_word_language(F.col("text")).alias("guess"))


@query("eval_recall_precision", """
WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[#*$%&|<>]{3}|!!') THEN 0 ELSE 1 END AS guess FROM documents),
j AS (SELECT l.quality, d.guess FROM labels l JOIN d ON l.doc_id = d.doc_id)
SELECT count(*) AS n, round(count(*) FILTER (WHERE guess = 1 AND quality = 1) / count(*) FILTER (WHERE guess = 1), 6) AS precision_1,
  round(count(*) FILTER (WHERE guess = 1 AND quality = 1) / count(*) FILTER (WHERE quality = 1), 6) AS recall_1, round(avg((guess = quality)::INT), 6) AS accuracy FROM j""")
def eval_recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").rlike("[#*$%&|<>]{3}|!!"), 0).otherwise(1).alias("guess"))
    j = table(spark, sf_dir, "labels").select("doc_id", "quality").join(guess, "doc_id")

    hit, said, true = F.count_if((F.col("guess") == 1) & (F.col("quality") == 1)), F.count_if(F.col("guess") == 1), F.count_if(F.col("quality") == 1)
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(hit / said, 6).alias("precision_1"), F.round(hit / true, 6).alias("recall_1"), F.round(F.avg((F.col("guess") == F.col("quality")).cast("int")), 6).alias("accuracy"))


@query("pdf_pages", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id::VARCHAR AS path, ((n - 1) // 40 + 1)::INTEGER AS page, string_agg(rtrim(line, ' ' || chr(9)), chr(10) ORDER BY n) AS text FROM l GROUP BY 1, 2""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PDF of 40 lines a page, and its pages read back."""
    return pdf.pdf_pages(pdf.as_pdf(table(spark, sf_dir, "documents"), "doc_id", "text")).where("error is null").select("path", "page", "text")


@query("pdf_sections", """
WITH l AS (SELECT doc_id::VARCHAR AS path, len(string_split(text, chr(10))) AS n FROM documents), p AS (SELECT path, (n - 1) // 40 + 1 AS last, unnest(range(1, (n - 1) // 40 + 2)) AS page FROM l)
SELECT path, (page - 1)::INTEGER AS node, CASE WHEN page > 1 THEN 0 END::INTEGER AS parent, CASE WHEN page > 1 THEN 2 ELSE 1 END::INTEGER AS level, 'Part ' || page AS title, page::INTEGER AS page, CASE WHEN page = 1 THEN last ELSE page END::INTEGER AS end_page FROM p""")
def pdf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of these files as sections: the first page is the head of all others."""
    return pdf.file_sections(pdf.as_pdf(table(spark, sf_dir, "documents"), "doc_id", "text"))
