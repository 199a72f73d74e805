"""Schemas and readers of the document side: tables, text files, Markdown, pages, subtitles, JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattice.functions import text as tx

SCHEMAS = {
    "documents": "doc_id STRING, doc_name STRING, doc_type STRING, doc_description STRING, file_size BIGINT, file_mtime DOUBLE, file_head_md5 STRING, file_md5 STRING, content_hash STRING, paragraph_count INT, page_count INT, line_count INT, node_count INT, status STRING, raw STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "document_bindings": "doc_id STRING, user_id STRING, kb_id STRING, session_id STRING, is_temporary BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "doc_nodes": "doc_id STRING, node_id STRING, parent_node_id STRING, sibling_order INT, level SMALLINT, title STRING, text STRING, summary STRING, paragraph_index INT, start_index INT, end_index INT, child_count SMALLINT",
    "doc_pages": "doc_id STRING, page_number INT, content STRING",
    "ingestion_tasks": "task_id STRING, doc_id STRING, user_id STRING, kb_id STRING, status STRING, progress INT, current_step STRING, retry_count INT, idempotency_key STRING, persisted_doc_ids ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP",
    "ingestion_task_events": "id BIGINT, task_id STRING, status STRING, event_payload STRING, created_at TIMESTAMP",
    "article_artifacts": "artifact_id STRING, session_id STRING, revision INT, parent_artifact_id STRING, status STRING, current_stage STRING, approved_through_stage STRING, material_library STRING, expires_at TIMESTAMP, updated_at TIMESTAMP",
    "search_documents": "video_id STRING, path STRING, duration DOUBLE, tags ARRAY<STRING>, description STRING, caption_text STRING, embedding ARRAY<FLOAT>",
    "videos": "video_id STRING, path STRING, duration DOUBLE, segments ARRAY<STRUCT<segment_id: STRING, start: DOUBLE, end: DOUBLE, is_representative: BOOLEAN, rank: INT, score: DOUBLE>>",
    "images": "image_id STRING, path STRING, width INT, height INT, subject STRING, color STRING, action STRING, style STRING, embedding ARRAY<FLOAT>",
}
FORMATS = ("pdf", "docx", "pptx", "xlsx", "md", "txt", "html", "csv")
KEYS = {"documents": ["doc_id"], "document_bindings": ["doc_id", "user_id", "kb_id"], "doc_nodes": ["doc_id", "node_id"], "doc_pages": ["doc_id", "page_number"], "ingestion_tasks": ["task_id", "status"], "ingestion_task_events": ["id", "task_id"], "search_documents": ["video_id"], "videos": ["video_id"], "images": ["image_id"], "article_artifacts": ["session_id", "revision"]}


def checked(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the table's rules, and the others: key columns present, formats known, revisions positive."""
    good = F.lit(True)
    for k in KEYS.get(name, []):
        good = good & F.col(k).isNotNull()
    if name == "documents":
        good = good & F.coalesce(F.col("doc_type").isin(*FORMATS), F.lit(False))
    if name == "ingestion_tasks":
        good = good & F.coalesce(F.col("progress").between(0, 100), F.lit(False))
    if name == "article_artifacts":
        good = good & F.coalesce(F.col("revision") > 0, F.lit(False))
    return df.where(good), df.where(~good)


def stored(df: DataFrame, name: str, path: str) -> DataFrame:
    """Write the rows of a table that keep its rules and read them back with the table's schema; the others go beside it, to ``<path>.rejected``.

    Columns of the schema that ``df`` lacks are null; others of ``df`` are left out.
    """
    fields = StructType.fromDDL(SCHEMAS[name])
    whole = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    good, bad = checked(whole, name)
    good.write.mode("overwrite").parquet(path)
    bad.write.mode("overwrite").parquet(f"{path}.rejected")
    return df.sparkSession.read.schema(fields).parquet(path)


def files(spark: SparkSession, root: str, pattern: str = "*.{pdf,docx,md,markdown}") -> DataFrame:
    """Files directly in ``root`` with their lower-case name as ``sort_name``; contents are read only if the column is used.

    Sort by ``sort_name`` and ``name`` after dropping the contents: a sort here would move them.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(name.alias("name"), F.lower(name).alias("sort_name"), "path", "length", "modificationTime", "content")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 (a byte-order mark left out), else GB18030 where the bytes are valid in it, else Latin-1. Line ends become line feeds."""
    as_text = content.cast("string")
    bare = F.regexp_replace(as_text, "^\ufeff", "")

    def other(raw: pd.Series) -> pd.Series:
        def read(b: bytes | None) -> str | None:
            if b is None:
                return None
            try:
                return b.decode("gb18030")
            except UnicodeDecodeError:
                return b.decode("latin-1")

        return raw.map(read)

    # only bytes that are no UTF-8 reach Python
    wrong = ~F.is_valid_utf8(as_text)
    return tx.newlines(F.when(wrong, F.pandas_udf(other, "string")(F.when(wrong, content))).otherwise(bare))


def byte_range(content: Column, offset: int, length: int) -> Column:
    return F.substring(content, offset + 1, length)


def markdown_headings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, level, title) of ATX headings outside fenced code."""
    lines = docs.select(doc_id, F.posexplode(F.split(tx.newlines(F.col(text)), "\n")).alias("pos", "line"))
    w = Window.partitionBy(doc_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("line").rlike("^\\s*(```|~~~)")
    inside = F.coalesce(F.sum(fence.cast("int")).over(w), F.lit(0)) % 2 == 1
    marked = lines.select(doc_id, "pos", "line", fence.alias("fence"), inside.alias("inside"))
    heading = F.regexp_extract("line", "^(#{1,6})\\s+(.+?)\\s*#*\\s*$", 1)
    found = marked.where(~F.col("inside") & ~F.col("fence") & (heading != ""))
    return found.select(doc_id, (F.col("pos") + 1).alias("line_no"), F.length(heading).alias("level"), F.regexp_extract("line", "^(#{1,6})\\s+(.+?)\\s*#*\\s*$", 2).alias("title"))


def marked_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines_per_page: int = 120) -> DataFrame:
    """(doc_id, line_no, page, line): pages by ``[[PAGE n]]`` lines where a document has any, else by a fixed number of lines."""
    lines = docs.select(doc_id, F.posexplode(F.split(tx.newlines(F.col(text)), "\n")).alias("pos", "line"))
    number = F.nullif(F.regexp_extract("line", "^\\s*\\[\\[PAGE (\\d+)\\]\\]\\s*$", 1), F.lit("")).cast("int")
    w = Window.partitionBy(doc_id)
    running = F.last(number, ignorenulls=True).over(w.orderBy("pos"))
    rows = lines.select(doc_id, "pos", "line", number.alias("mark"), running.alias("running"), F.max(number.isNotNull()).over(w).alias("any"))
    page = F.when(F.col("any"), F.coalesce("running", F.lit(1))).otherwise(F.floor(F.col("pos") / lines_per_page) + 1)
    return rows.where(F.col("mark").isNull()).select(doc_id, (F.col("pos") + 1).alias("line_no"), page.cast("int").alias("page"), "line")


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, text) of SRT files, whatever their line ends; a file is split as a whole."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split(tx.newlines(F.col("value")), "\n[ \t]*\n")).alias("b"))
    stamp = "(\\d+):(\\d+):(\\d+)[,.](\\d+)"
    pattern = f"(?s)^\\s*(?:\\d+\\s*\\n)?\\s*{stamp}\\s*-->\\s*{stamp}[^\\n]*\\n(.*)$"
    part = lambda i: F.regexp_extract("b", pattern, i)
    at = lambda i: part(i).cast("double") * 3600 + part(i + 1).cast("double") * 60 + part(i + 2).cast("double") + F.rpad(part(i + 3), 3, "0").cast("double") / 1000
    return blocks.where(F.col("b").rlike(pattern)).select(at(1).alias("start"), at(5).alias("end"), F.regexp_replace(part(9), "^\\s+|\\s+$", "").alias("text"))


def ass_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, style, text) of the dialogue lines of ASS files; override tags go, ``\\\\N`` is a line feed."""
    lines = spark.read.text(path).select(F.rtrim("value").alias("b"))
    pattern = "^Dialogue:\\s*[^,]*,(\\d+):(\\d+):(\\d+)\\.(\\d+),(\\d+):(\\d+):(\\d+)\\.(\\d+),([^,]*)(?:,[^,]*){5},(.*)$"
    part = lambda i: F.regexp_extract("b", pattern, i)
    at = lambda i: part(i).cast("double") * 3600 + part(i + 1).cast("double") * 60 + part(i + 2).cast("double") + part(i + 3).cast("double") / 100
    text = F.regexp_replace(F.regexp_replace(part(10), "\\{[^}]*\\}", ""), "\\\\[Nn]", "\n")
    return lines.where(F.col("b").rlike(pattern)).select(at(1).alias("start"), at(5).alias("end"), F.trim(part(9)).alias("style"), text.alias("text"))


def write_ass(cues: DataFrame, path: str, style: str = "Default") -> None:
    """An ASS file of (start, end, text) in order of start; like any player file, one partition."""
    clock = lambda c: F.format_string("%d:%02d:%02d.%02d", F.floor(c / 3600), F.floor(c / 60) % 60, F.floor(c) % 60, F.floor(F.round(c * 100)) % 100)
    head = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
    line = F.concat(F.lit("Dialogue: 0,"), clock(F.col("start")), F.lit(","), clock(F.col("end")), F.lit(f",{style},,0,0,0,,"), F.replace("text", F.lit("\n"), F.lit("\\N")))
    rows = cues.select(F.lit(1).alias("k"), "start", "end", line.alias("value"))
    first = cues.sparkSession.createDataFrame([(0, 0.0, 0.0, head)], "k int, start double, end double, value string")
    first.unionByName(rows).repartition(1).sortWithinPartitions("k", "start", "end", "value").select("value").write.mode("overwrite").text(path)


def write_subtitles(cues: DataFrame, path: str) -> None:
    """SRT blocks of (start, end, text) in order of start; one file, as players expect, so one film is one task."""
    numbered = cues.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("start", "end", "text")))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), tx.subtitle_time(F.col("start")), F.lit(" --> "), tx.subtitle_time(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    numbered.repartition(1).sortWithinPartitions("n").select(block.alias("value")).write.mode("overwrite").text(path)


def write_content_list(blocks: DataFrame, path: str) -> None:
    """JSON lines of layout blocks."""
    blocks.write.mode("overwrite").json(path)
