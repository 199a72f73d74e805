"""Ranked retrieval without scoring every pair: an impact-ordered index in blocks with upper bounds, and top-k that prunes by them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.operators import search
from lattice.session import scratch

#: Postings of a term that share one upper bound.
BLOCK = 128
#: Postings that one task holds in an index of its own, and query terms that are sent to all tasks together.
SHARD_POSTINGS, QUERY_TERMS = 2_000_000, 500_000
#: Scores are compared with this slack, since they are rounded to six digits at the end.
_SLACK = 2e-6


@dataclass(frozen=True)
class Scheme:
    """score = sum over the shared terms of weight(term) * impact(term frequency, length)."""

    name: str
    weighted: bool  # by ln(1 + (N - df + .5) / (df + .5)), else 1

    def impact(self, tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
        if self.name == "okapi":
            return tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))
        if self.name == "unit_recall":
            return 1 / np.maximum(0.2, 0.25 + 0.75 * length / mean)
        return 10.0 + np.minimum(tf, 5)


#: Okapi BM25 (k1 1.5, b .75); idf over a damped length, whatever the term frequency; 10 + min(tf, 5) a term.
OKAPI, UNIT_RECALL, TERM_HITS = Scheme("okapi", True), Scheme("unit_recall", True), Scheme("term_hits", False)


# --- one shard ----------------------------------------------------------------------------------


class Shard:
    """The postings of some documents: by term, the greatest impact first, with the bound of each block of postings."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.by_doc = np.lexsort((doc, term))  # for look-ups of single documents
        self.doc_sorted, self.impact_sorted = doc[self.by_doc], impact[self.by_doc]

    def bounds(self, t: int) -> np.ndarray:
        return self.impact[self.first[t] : self.first[t + 1] : BLOCK]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, rounded scores, number of documents scored to the end) of the k best; ``least``: a score that k documents are known to reach; ``order``: rank of the documents' ids.

        Terms come by their upper bounds, greatest first. A block of postings whose bound, with all that later terms can add,
        stays below the threshold brings no new candidate; when the later terms alone stay below it, they are looked up for the
        candidates that are left, which are cut after each term.
        """
        some = self.first[terms + 1] > self.first[terms]
        terms, weights = terms[some], weights[some]
        top = weights * self.impact[self.first[terms]]
        by = np.argsort(-top, kind="stable")
        terms, weights, top = terms[by], weights[by], top[by]
        rest = np.append(np.cumsum(top[::-1])[::-1], 0.0)
        score, seen = np.zeros(self.n_docs), np.zeros(self.n_docs, bool)
        j = 0
        while j < len(terms) and rest[j] >= least - _SLACK:
            a, b = self.first[terms[j]], self.first[terms[j] + 1]
            doc = self.doc[a:b]
            score[doc] += weights[j] * self.impact[a:b]
            full = int(np.count_nonzero(weights[j] * self.bounds(terms[j]) + rest[j + 1] >= least - _SLACK))
            seen[doc[: full * BLOCK]] = True
            j += 1
            if (j < 3 or j % 8 == 0) and self.n_docs > k:
                least = max(least, float(np.partition(score, -k)[-k]))
        left = np.flatnonzero(seen & (score + rest[j] >= least - _SLACK))
        for i in range(j, len(terms)):
            a, b = self.first[terms[i]], self.first[terms[i] + 1]
            own = self.doc_sorted[a:b]
            at = np.minimum(np.searchsorted(own, left), len(own) - 1)
            hit = own[at] == left
            score[left[hit]] += weights[i] * self.impact_sorted[a:b][at[hit]]
            if len(left) > k:
                least = max(least, float(np.partition(score[left], -k)[-k]))
            left = left[score[left] + rest[i + 1] >= least - _SLACK]
        rounded = np.round(score[left], 6)
        first = np.lexsort((order[left], -rounded))[:k]
        return left[first], rounded[first], len(left)


# --- the index ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """(doc_id, len, terms, tfs) in the shared folder: of each document the numbers of the query terms it holds."""

    rows: DataFrame
    vocabulary: pa.Array
    frequency: np.ndarray
    n: int
    mean: float


def build(docs: DataFrame, doc_id: str, terms: Column, vocabulary: pa.Array) -> Index:
    """Tokenise every document once and keep what the vocabulary has; lengths count all terms. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    picked = docs.select(F.col(doc_id).alias("doc_id"), terms.alias("_terms"))
    schema = T.StructType([picked.schema["doc_id"], *T.StructType.fromDDL("len int, terms array<int>, tfs array<int>").fields])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.list_value_length(lists)
            known = pc.index_in(lists.flatten(), shared.value)
            doc = np.repeat(np.arange(batch.num_rows), lengths.fill_null(0).to_numpy(zero_copy_only=False))
            hit = known.is_valid().to_numpy(zero_copy_only=False)
            keys, tf = np.unique(doc[hit].astype(np.int64) << 32 | known.fill_null(0).to_numpy().astype(np.int64)[hit], return_counts=True)
            bounds = pa.array(np.searchsorted(keys >> 32, np.arange(batch.num_rows + 1)).astype(np.int32))
            as_lists = lambda v: pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths.cast(pa.int32()), as_lists(keys & 0xFFFFFFFF), as_lists(tf)], names=schema.names)

    path = scratch(docs.sparkSession, "index")
    picked.mapInArrow(number, schema).write.parquet(path)
    rows = docs.sparkSession.read.schema(schema).parquet(path)
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("len")).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    found = rows.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    frequency[found.column("t").to_numpy()] = found.column("count").to_numpy()
    return Index(rows, vocabulary, frequency, int(n or 0), float(mean or 1.0) or 1.0)


def _blocks(queries: DataFrame, query_id: str, terms: Column) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """Vocabulary, ids, and the CSR of term numbers of the queries, in blocks of bounded size."""
    sized = queries.select(F.col(query_id).alias("q"), F.array_distinct(terms).alias("t"))
    total = sized.agg(F.sum(F.size("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / QUERY_TERMS))
    for i in range(blocks):
        own = sized.where((F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) & (F.size("t") > 0)).toArrow().combine_chunks()
        lists = own.column(1).combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
        yield coded.dictionary, own.column(0), coded.indices.to_numpy(zero_copy_only=False), ends


def _answerer(schemes: Sequence[tuple[Scheme, int]], sent: Broadcast, mean: float, least: dict[str, dict[int, float]], names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """The answers of one shard to every query of a block."""

    def answer(table: pa.Table) -> pa.Table:
        ids, numbers, ends, idf = sent.value
        table = table.combine_chunks()
        lists = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        term, tf = lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()
        length = table.column("len").combine_chunks().fill_null(0).to_numpy()[doc]
        order = np.empty(table.num_rows, np.int64)
        order[pc.sort_indices(table.column("doc_id")).to_numpy()] = np.arange(table.num_rows)
        labels: list[str] = []
        parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for scheme, k in schemes:
            shard = Shard(doc, term, scheme.impact(tf, length, mean), table.num_rows, len(idf))
            known = least.get(scheme.name, {})
            for i in range(len(ids)):
                terms = numbers[ends[i] : ends[i + 1]]
                weights = idf[terms] if scheme.weighted else np.ones(len(terms))
                best, score, n = shard.best(terms, weights, k, known.get(i, 0.0), order)
                labels += [scheme.name] * len(best)
                parts.append((np.full(len(best), i), best, score, np.full(len(best), n)))
        query, rows, score, scored = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.table([pa.array(labels, pa.string()), pc.take(ids, pa.array(query)), table.column("doc_id").take(pa.array(rows)), pa.array(score), pa.array(scored)], names=names)

    return answer


def top_k(docs: DataFrame, doc_id: str, doc_terms: Column, queries: DataFrame, query_id: str, query_terms: Column, schemes: Sequence[tuple[Scheme, int]], counts: bool = False) -> DataFrame:
    """(scheme, query_id, doc_id, score, rank) of the k best documents of each query by each (scheme, k); ties by doc_id.

    The documents are dealt to shards by a hash, each of which builds an index and answers every query of a block from it. The
    first shard runs alone: its k-th best scores are thresholds for all others. A shard returns k documents a query at most, so
    no step holds all pairs. Repeated ids count each; null texts match nothing. With ``counts``: also ``scored``, how many
    documents of the shard were scored to the end for the query.
    """
    spark = docs.sparkSession
    out = None
    id_field = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"]
    q_field = queries.select(F.col(query_id).alias("q")).schema["q"]
    found_schema = T.StructType([T.StructField("scheme", T.StringType()), T.StructField(query_id, q_field.dataType), T.StructField(doc_id, id_field.dataType), T.StructField("score", T.DoubleType()), T.StructField("scored", T.LongType())])
    for vocabulary, ids, numbers, ends in _blocks(queries, query_id, query_terms):
        index = build(docs, doc_id, doc_terms, vocabulary)
        idf = np.log(1 + (index.n - index.frequency + 0.5) / (index.frequency + 0.5))
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(index.frequency.sum()) / SHARD_POSTINGS), 2)
        sent = spark.sparkContext.broadcast((ids, numbers, ends, idf))
        dealt = index.rows.withColumn("_shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

        path = scratch(spark, "first")
        dealt.where("_shard = 0").groupBy("_shard").applyInArrow(_answerer(schemes, sent, index.mean, {}, found_schema.names), found_schema).write.parquet(path)
        first = spark.read.schema(found_schema).parquet(path)
        place = {q: i for i, q in enumerate(ids.to_pylist())}
        least: dict[str, dict[int, float]] = {}
        for scheme, k in schemes:
            kth = first.where(F.col("scheme") == scheme.name).groupBy(query_id).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
            least[scheme.name] = {place[r[0]]: r[2] for r in kth.collect()}
        others = dealt.where("_shard > 0").groupBy("_shard").applyInArrow(_answerer(schemes, sent, index.mean, least, found_schema.names), found_schema)
        both = first.unionByName(others)
        out = both if out is None else out.unionByName(both)
    most = F.coalesce(*(F.when(F.col("scheme") == s.name, k) for s, k in schemes))
    ranked = search.top_k(out, ["scheme", query_id], [F.desc("score"), F.asc(doc_id)], max(k for _, k in schemes)).where(F.col("rank") <= most)
    return ranked if counts else ranked.drop("scored")
