"""Substring scores of a batch of queries against whole texts: one automaton over all terms, run once over each text."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.operators import search

#: Characters of terms and phrases that go into one automaton, and texts whose counts stand in one matrix.
PATTERN_CHARACTERS, TEXTS = 500_000, 256


@dataclass(frozen=True)
class Patterns:
    """The distinct terms and phrases of a block of queries; each query has the numbers of its terms and of its phrase (-1: none)."""

    strings: list[str]
    ids: list
    terms: list[np.ndarray]
    phrases: list[int]
    flagged: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[tuple[object, str | None, Sequence[str] | None, bool]]) -> Patterns:
        number: dict[str, int] = {}
        terms = [np.array([number.setdefault(t, len(number)) for t in dict.fromkeys(r[2] or ()) if t], np.int64) for r in rows]
        phrases = [number.setdefault(r[1], len(number)) if r[1] else -1 for r in rows]
        return cls(list(number), [r[0] for r in rows], terms, phrases, np.array([bool(r[3]) for r in rows]))

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i, s in enumerate(self.strings):
            out.add_word(s, (i, len(s)))
        if self.strings:
            out.make_automaton()
        return out


def occurrences(automaton: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """How often each pattern stands in the text, those that overlap themselves counted from the left."""
    count: dict[int, int] = {}
    last: dict[int, int] = {}
    if len(automaton):
        for end, (i, size) in automaton.iter(text):
            if end - size >= last.get(i, -1):
                count[i] = count.get(i, 0) + 1
                last[i] = end
    return count


def _points(counts: list[dict[int, int]], size: int, base: int, most: int) -> np.ndarray:
    """base + min(count, most) of each text and pattern, 0 where it is missing."""
    out = np.zeros((len(counts), size))
    for row, count in zip(out, counts, strict=True):
        if count:
            row[list(count)] = base + np.minimum(list(count.values()), most)
    return out


def scores(patterns: Patterns, content: list[dict[int, int]], metadata: list[dict[int, int]]) -> np.ndarray:
    """A row for each text, a column for each query: 40 for the phrase in the content, 20 in the metadata; a term 10 and up to 5 by its count in the content, 5 and up to 3 in the metadata."""
    size = len(patterns.strings)
    by_term = _points(content, size, 10, 5) + _points(metadata, size, 5, 3)
    out = np.zeros((len(content), len(patterns.ids)))
    for q, (terms, phrase) in enumerate(zip(patterns.terms, patterns.phrases, strict=True)):
        out[:, q] = by_term[:, terms].sum(1)
        if phrase >= 0:
            out[:, q] += [40 * (phrase in c) + 20 * (phrase in m) for c, m in zip(content, metadata, strict=True)]
    return out


def substring_top_k(docs: DataFrame, doc_id: str, content: Column, metadata: Column, queries: DataFrame, query_id: str, phrase: Column, terms: Column, k: int, bonus: Column | None = None, flag: Column | None = None, flag_bonus: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents above 0 of each query, ties by doc_id.

    Texts, phrases and terms are compared as they are (fold their case before). ``bonus`` adds to a document's scores,
    ``flag_bonus`` to those for queries with ``flag``. A task runs each text once through the automaton of all queries of a
    block (blocks have a bounded size; there are more of them when the queries grow) and hands on k documents a query.
    Null texts are empty; repeated ids count each; queries without terms and phrase match by their bonus alone.
    """
    zero = F.lit(0.0)
    picked = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(content, F.lit("")).alias("c"), F.coalesce(metadata, F.lit("")).alias("m"),
        F.coalesce(zero if bonus is None else bonus, zero).cast("double").alias("b"), F.coalesce(zero if flag_bonus is None else flag_bonus, zero).cast("double").alias("f"),
    )
    asked = queries.select(F.col(query_id).alias("q"), phrase.alias("p"), terms.alias("t"), (F.lit(False) if flag is None else flag).alias("f"))
    characters = F.coalesce(F.length("p"), F.lit(0)) + F.coalesce(F.length(F.array_join("t", "")), F.lit(0))
    blocks = max(1, math.ceil((asked.agg(F.sum(characters)).first()[0] or 0) / PATTERN_CHARACTERS))
    schema = T.StructType([T.StructField(query_id, asked.schema["q"].dataType), T.StructField(doc_id, picked.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    out = None
    for i in range(blocks):
        block = Patterns.of([tuple(r) for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()])
        part = picked.mapInArrow(_best(docs.sparkSession.sparkContext.broadcast(block), k, schema), schema)
        out = part if out is None else out.unionByName(part)
    return search.top_k(out, [query_id], [F.desc("score"), F.asc(doc_id)], k)


def _best(shared, k: int, schema: T.StructType):
    """The k best documents of a partition for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: Patterns = shared.value
        automaton = patterns.automaton()
        held: list[list[tuple]] = [[] for _ in patterns.ids]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids, content, metadata = (c.to_pylist() for c in part.columns[:3])
                found = scores(patterns, [occurrences(automaton, c) for c in content], [occurrences(automaton, m) for m in metadata])
                found += part.column(3).to_numpy()[:, None] + np.outer(part.column(4).to_numpy(), patterns.flagged)
                for q, own in enumerate(held):
                    least = own[-1][0] if len(own) == k else 0.0
                    rows = np.flatnonzero((found[:, q] > 0) & (-found[:, q] <= least if len(own) == k else True))
                    if len(rows):
                        own += [(-found[r, q], ids[r] is not None, ids[r]) for r in rows.tolist()]
                        own.sort()
                        del own[k:]
        rows = [(patterns.ids[q], i, -float(s)) for q, own in enumerate(held) for s, _, i in own]
        kinds = pa.schema([(f.name, pa.int64() if f.dataType == T.LongType() else pa.int32() if f.dataType == T.IntegerType() else pa.float64() if f.dataType == T.DoubleType() else pa.string()) for f in schema])
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    return run
