"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of
``documents``. ``run`` writes every stage's result to the shared folder and reads it back, so a lost executor or a later
failure repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.catalog import table
from lattice.llm import mixing, neardup, packing, quality, secrets
from lattice.llm.common import written
from lattice.llm.queries import MIX_WEIGHTS

#: SQL cannot express these stages; tests compare them with plain versions.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that clash with nothing, and the new name of each column."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the outlier test rejects go.

    Null, empty and blank texts fail the base rule. Null languages and sources are groups of their own; repeated rows get equal
    verdicts; null ids don't matter. An empty table stays empty.
    """
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group, linked from a similarity of 0.8 on, stays; one without an id has no group and stays."""
    gone = neardup.near_duplicates(docs, num=80, den=100).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the text, and n_chars follows; no document goes.

    A null text stays null, a text without secrets stays as it is with its n_chars; overlapping finds are replaced as one. Ids
    don't matter. An empty table stays empty.
    """
    again, name = _numbered(docs)
    text = name["text"]
    found = secrets.scan_secrets(again, id_col=name["doc_id"], text_col=text, keep=tuple(c for c in again.columns if c != text), redact=True)
    changed = F.col("spans") != ""
    columns = {name["doc_id"]: F.col("doc_id"), text: F.col("redacted"), name["n_chars"]: F.when(changed, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(name["n_chars"]))}
    return found.select(*(columns.get(c, F.col(c)).alias(c) for c in again.columns)).toDF(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated towards the target weights and shuffled; copies keep their id.

    Rows that repeat an id get the same number of copies each; a null id is hashed by its text; null and unnamed sources share one
    weight; null and empty texts have no mass but are copied. An empty table stays empty.
    """
    again, name = _numbered(docs)
    mixed = mixing.mix_sources(again, MIX_WEIGHTS, id_col=name["doc_id"], source_col=name["source"], text_col=name["text"])
    return mixed.select(again.columns).toDF(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece of a document.

    Null and empty texts are the end token alone; rows that repeat an id (copies of the stage before) are documents of their own.
    An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
