"""The document side's own tables, filled from the driver's, written under their rules and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.catalog import table
from lattice.plans.registry import query
from lattice.session import scratch
from lattice.sources import constraints
from lattice.sources import documents as docs

#: Table, source, Spark expressions, DuckDB twin over the same columns; rows that break a rule are left out.
_STORED = {
    "documents": ("documents", ["cast(doc_id as string) doc_id", "concat('doc ', doc_id) doc_name", "case when doc_id % 7 = 0 then 'exe' else 'md' end doc_type", "octet_length(text) file_size", "sha2(text, 256) content_hash", "'ready' status"],
        "SELECT doc_id::VARCHAR AS doc_id, 'doc ' || doc_id AS doc_name, 'md' AS doc_type, strlen(text) AS file_size, sha256(text) AS content_hash, 'ready' AS status FROM documents WHERE doc_id % 7 <> 0"),
    "document_bindings": ("orders", ["cast(o_orderkey as string) doc_id", "cast(o_custkey as string) user_id", "case when o_orderkey % 9 > 0 then 'kb' end kb_id", "o_orderstatus = 'P' is_temporary"],
        "SELECT o_orderkey::VARCHAR AS doc_id, o_custkey::VARCHAR AS user_id, 'kb' AS kb_id, o_orderstatus = 'P' AS is_temporary FROM orders WHERE o_orderkey % 9 > 0"),
    "doc_nodes": ("conversations", ["cast(conv_id as string) doc_id", "concat('n', turn) node_id", "case when turn > 0 then concat('n', turn - 1) end parent_node_id", "cast(turn as int) sibling_order", "role title", "text"],
        "SELECT conv_id::VARCHAR AS doc_id, 'n' || turn AS node_id, CASE WHEN turn > 0 THEN 'n' || (turn - 1) END AS parent_node_id, turn::INT AS sibling_order, role AS title, text FROM conversations"),
    "doc_pages": ("conversations", ["cast(conv_id as string) doc_id", "cast(nullif(turn, 1) + 1 as int) page_number", "text content"],
        "SELECT conv_id::VARCHAR AS doc_id, (turn + 1)::INT AS page_number, text AS content FROM conversations WHERE turn <> 1"),
    "ingestion_tasks": ("orders", ["cast(o_orderkey as string) task_id", "cast(o_custkey as string) doc_id", "o_orderstatus status", "cast(o_orderkey % 100 as int) progress"],
        "SELECT o_orderkey::VARCHAR AS task_id, o_custkey::VARCHAR AS doc_id, o_orderstatus AS status, (o_orderkey % 100)::INT AS progress FROM orders"),
    "ingestion_task_events": ("events", ["event_id id", "cast(user_id as string) task_id", "event_type status", "props event_payload"],
        "SELECT event_id AS id, user_id::VARCHAR AS task_id, event_type AS status, props AS event_payload FROM events"),
    "article_artifacts": ("conversations", ["concat(conv_id, '-', turn) artifact_id", "cast(conv_id as string) session_id", "cast(turn as int) revision", "role status"],
        "SELECT conv_id || '-' || turn AS artifact_id, conv_id::VARCHAR AS session_id, turn::INT AS revision, role AS status FROM conversations WHERE turn > 0"),
    "search_documents": ("embeddings", ["cast(vec_id as string) video_id", "concat('v/', vec_id) path", "cast(label as double) duration", "array(cast(label as string)) tags"],
        "SELECT vec_id::VARCHAR AS video_id, 'v/' || vec_id AS path, label::DOUBLE AS duration, [label::VARCHAR] AS tags FROM embeddings"),
    "videos": ("part", ["cast(p_partkey as string) video_id", "p_name path", "cast(p_size as double) duration", "array(named_struct('segment_id', p_brand, 'start', 0D, 'end', cast(p_size as double), 'is_representative', true, 'rank', 1, 'score', 1D)) segments"],
        "SELECT p_partkey::VARCHAR AS video_id, p_name AS path, p_size::DOUBLE AS duration, p_brand AS segment_id FROM part"),
    "images": ("pages", ["cast(page_id as string) image_id", "url path", "cast(length(html) as int) width"],
        "SELECT page_id::VARCHAR AS image_id, url AS path, length(html)::INT AS width FROM pages"),
}


def _stored(name: str, source: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).selectExpr(*columns)
        kept = docs.stored(rows, name, scratch(spark, name)).select(*rows.columns)
        return kept.selectExpr("video_id", "path", "duration", "segments[0].segment_id AS segment_id") if name == "videos" else kept

    return run


for _name, (_source, _columns, _sql) in _STORED.items():
    query(f"stored_{_name}", _sql)(_stored(_name, _source, _columns))


# --- rules ------------------------------------------------------------------------------------------

_NAMED = """
WITH d AS (SELECT doc_id::VARCHAR AS doc_id, doc_id AS n, 0 AS copy FROM documents UNION ALL SELECT doc_id::VARCHAR, doc_id, 1 FROM documents WHERE doc_id % 10 = 3),
r AS (SELECT doc_id, copy, CASE WHEN n % 11 <> 0 THEN 'doc ' || n END AS doc_name, CASE WHEN n % 7 = 0 THEN 'exe' ELSE 'md' END AS doc_type, CASE WHEN n % 13 <> 0 THEN 'failed' END AS status FROM d),
b AS (SELECT *, concat_ws(',', CASE WHEN doc_name IS NULL THEN 'required:doc_name' END, CASE WHEN doc_type = 'exe' THEN 'domain:doc_type' END) AS other FROM r),
j AS (SELECT doc_id, copy, doc_name, coalesce(status, 'ready') AS status, CASE WHEN other <> '' THEN other WHEN row_number() OVER (PARTITION BY doc_id, other ORDER BY copy) > 1 THEN 'unique:doc_id' ELSE '' END AS broken FROM b)
"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a name, of a wrong type, without a status, and some twice."""
    d = table(spark, sf_dir, "documents")
    both = d.select("doc_id", F.lit(0).alias("copy")).unionAll(d.where("doc_id % 10 = 3").select("doc_id", F.lit(1)))
    rows = both.selectExpr("cast(doc_id as string) doc_id", "copy", "case when doc_id % 11 <> 0 then concat('doc ', doc_id) end doc_name", "case when doc_id % 7 = 0 then 'exe' else 'md' end doc_type", "case when doc_id % 13 <> 0 then 'failed' end status")
    return constraints.judged(rows, constraints.TABLES["documents"], order=[F.col("copy")])


@query("document_rules", _NAMED + "SELECT doc_id, copy, doc_name, status, broken FROM j")
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", "copy", "doc_name", "status", F.array_join("broken", ",").alias("broken"))


@query("binding_rules", _NAMED + """
, o AS (SELECT (o_orderkey % 1500)::VARCHAR AS doc_id, o_orderkey AS seq, (o_custkey % 3)::VARCHAR AS user_id, CASE WHEN o_orderkey % 9 > 0 THEN 'kb' END AS kb_id FROM orders),
k AS (SELECT o.*, concat_ws(',', CASE WHEN kb_id IS NULL THEN 'required:kb_id' END, CASE WHEN doc_id NOT IN (SELECT doc_id FROM j WHERE broken = '') THEN 'reference:doc_id' END) AS other FROM o)
SELECT doc_id, seq, user_id, kb_id, CASE WHEN other <> '' THEN other WHEN row_number() OVER (PARTITION BY doc_id, user_id, kb_id, other ORDER BY seq) > 1 THEN 'unique:doc_id,user_id,kb_id' ELSE '' END AS broken FROM k""")
def binding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bindings of documents, of which some are not stored."""
    rows = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey % 1500 as string) doc_id", "o_orderkey seq", "cast(o_custkey % 3 as string) user_id", "case when o_orderkey % 9 > 0 then 'kb' end kb_id", "cast(null as boolean) is_temporary")
    judged = constraints.judged(rows, constraints.TABLES["document_bindings"], {"documents": constraints.kept(_named(spark, sf_dir))}, [F.col("seq")])
    return judged.select("doc_id", "seq", "user_id", "kb_id", F.array_join("broken", ",").alias("broken"))


@query("collection_rules", """
WITH v AS (SELECT vec_id, 0 AS copy, CASE WHEN vec_id % 9 = 0 THEN 63 WHEN vec_id % 10 <> 4 THEN 64 END AS dim FROM embeddings UNION ALL SELECT vec_id, 1, 64 FROM embeddings WHERE vec_id % 6 = 0)
SELECT vec_id, copy, CASE WHEN dim IS NULL THEN 'required:embedding' WHEN dim <> 64 THEN 'check:dimension' WHEN row_number() OVER (PARTITION BY vec_id, dim ORDER BY copy) > 1 THEN 'unique:vec_id' ELSE '' END AS broken FROM v""")
def collection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which some are short, missing or there twice."""
    v = table(spark, sf_dir, "embeddings")
    once = v.selectExpr("vec_id", "0 copy", "case when vec_id % 9 = 0 then slice(embedding, 1, 63) when vec_id % 10 <> 4 then embedding end embedding")
    judged = constraints.judged(once.unionAll(v.where("vec_id % 6 = 0").selectExpr("vec_id", "1", "embedding")), constraints.collection(64), order=[F.col("copy")])
    return judged.select("vec_id", "copy", F.array_join("broken", ",").alias("broken"))
