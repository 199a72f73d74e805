"""The rules of stored tables: required columns, domains, checks, references and unique keys, with the rows that break them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.session import cut


@dataclass(frozen=True)
class Rules:
    """``references``: columns of this table to (table, its columns); ``checks``: name to SQL condition; ``defaults``: column to SQL value for nulls."""

    required: Sequence[str] = ()
    domains: Mapping[str, Sequence[str]] = field(default_factory=dict)
    checks: Mapping[str, str] = field(default_factory=dict)
    references: Mapping[tuple[str, ...], tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    unique: Sequence[tuple[str, ...]] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)


# Document types, and what a table of documents asks of its rows.
DOCUMENT_TYPES = ("pdf", "md", "markdown", "docx", "txt", "html", "xlsx", "pptx")
TABLES = {
    "documents": Rules(("doc_id", "doc_name", "doc_type"), {"doc_type": DOCUMENT_TYPES}, {"doc_name": "length(doc_name) <= 512"}, {}, [("doc_id",)], {"status": "'ready'"}),
    "document_bindings": Rules(("doc_id", "user_id", "kb_id"), references={("doc_id",): ("documents", ("doc_id",))}, unique=[("doc_id", "user_id", "kb_id")], defaults={"is_temporary": "false"}),
    "doc_nodes": Rules(("doc_id", "node_id"), references={("doc_id",): ("documents", ("doc_id",))}, unique=[("doc_id", "node_id")], defaults={"sibling_order": "0", "child_count": "0"}),
    "doc_pages": Rules(("doc_id", "page_number"), references={("doc_id",): ("documents", ("doc_id",))}, unique=[("doc_id", "page_number")]),
}


def collection(dimension: int, key: str = "vec_id", vector: str = "embedding") -> Rules:
    """A collection of vectors: a unique key, and one dimension for all."""
    return Rules((key, vector), checks={"dimension": f"size({vector}) = {dimension}"}, unique=[(key,)])


def judged(rows: DataFrame, rules: Rules, parents: Mapping[str, DataFrame] | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """The rows with their defaults, and ``broken``: the names of the rules that each breaks, in the order required, domain, check, reference, unique.

    A null breaks no domain, check or reference (where the column is required it breaks that). Of rows that share a unique key
    and keep the other rules the first by ``order`` keeps it (any one of equals); nulls in a key are never equal. Keys are
    compared by an aggregation and a join, so a key that many rows share is no task of its own.
    """
    filled = rows.withColumns({c: F.coalesce(F.col(c), F.expr(v)) for c, v in rules.defaults.items()})
    marks = [F.when(F.col(c).isNull(), f"required:{c}") for c in rules.required]
    marks += [F.when(~F.col(c).isin(list(values)), f"domain:{c}") for c, values in rules.domains.items()]
    marks += [F.when(~F.expr(condition), f"check:{name}") for name, condition in rules.checks.items()]
    # a number for each row, written down: a repeated task would number anew
    own = cut(filled.withColumn("broken", F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")).withColumn("_row", F.struct(*order, F.monotonically_increasing_id().alias("_n"))))
    for columns, (name, theirs) in rules.references.items():
        there = parents[name].select(*(F.col(t).alias(f"_k{i}") for i, t in enumerate(theirs))).distinct().withColumn("_there", F.lit(True))
        joined = own.join(there, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)], "left")
        lost = F.col("_there").isNull()
        for c in columns:
            lost = lost & F.col(c).isNotNull()
        own = joined.withColumn("broken", F.when(lost, F.array_append("broken", F.lit(f"reference:{','.join(columns)}"))).otherwise(F.col("broken"))).drop("_there", *(f"_k{i}" for i in range(len(columns))))
    for columns in rules.unique:
        whole = F.lit(True)
        for c in columns:
            whole = whole & F.col(c).isNotNull()
        first = own.where(whole & (F.size("broken") == 0)).groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(columns))).agg(F.min("_row").alias("_first"))
        joined = own.join(first, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)], "left")
        later = F.col("_first").isNotNull() & (F.size("broken") == 0) & (F.col("_row") != F.col("_first"))
        own = joined.withColumn("broken", F.when(later, F.array_append("broken", F.lit(f"unique:{','.join(columns)}"))).otherwise(F.col("broken"))).drop("_first", *(f"_k{i}" for i in range(len(columns))))
    return own.drop("_row")


def kept(rows: DataFrame) -> DataFrame:
    """The judged rows that break no rule."""
    return rows.where(F.size("broken") == 0).drop("broken")
