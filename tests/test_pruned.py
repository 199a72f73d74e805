import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.operators import pruned

WORDS = [f"w{i}" for i in range(200)]


def corpus(seed, n):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i, None if i % 37 == 5 else " ".join(rng.choices(WORDS, weights, k=rng.choice([0, 3, 20, 80])))) for i in range(n)]


def plain(docs, queries, scheme, k):
    split = {i: (t or "").split() for i, t in docs}
    n, mean = len(docs), sum(len(t.split()) for _, t in docs if t is not None) / sum(t is not None for _, t in docs)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = {}
    for q, text in queries:
        scored = []
        for i, ws in split.items():
            tf = Counter(ws)
            shared = [w for w in set(text.split()) if w in tf]
            if shared:
                s = sum((math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) if scheme.weighted else 1) * float(scheme.impact(np.array(tf[w]), np.array(len(ws)), mean)) for w in shared)
                scored.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block", [2, 128])
def test_equal_to_scoring_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(pruned, "BLOCK", block)
    monkeypatch.setattr(pruned, "QUERY_TERMS", 60)
    docs, queries = corpus(1, 400), [(q, t) for q, t in corpus(2, 12) if t]
    schemes = [(pruned.OKAPI, 5), (pruned.UNIT_RECALL, 7), (pruned.TERM_HITS, 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "qid int, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    rows = pruned.top_k(d, "doc_id", words, q, "qid", words, schemes).collect()
    for scheme, k in schemes:
        want = plain(docs, queries, scheme, k)
        for qid, _ in queries:
            found = sorted((r.rank, r.doc_id, r.score) for r in rows if r.scheme == scheme.name and r.qid == qid)
            assert [(i, pytest.approx(s, abs=2e-6)) for _, i, s in found] == want[qid]


def test_few_documents_are_scored():
    """A rare term decides: the many documents that share only common terms are never scored to the end."""
    rng = np.random.default_rng(1)
    n = 20_000
    doc = np.concatenate([np.arange(n), np.arange(n), rng.choice(n, 50, replace=False)])
    term = np.repeat([0, 1, 2], [n, n, 50])
    impact = np.concatenate([rng.random(2 * n) * 0.5, 1 + rng.random(50)])
    shard = pruned.Shard(doc, term, impact, n, 3)
    best, score, scored = shard.best(np.array([0, 1, 2]), np.array([0.1, 0.1, 5.0]), 10, 0.0, np.arange(n))
    whole = np.zeros(n)
    np.add.at(whole, doc, impact * np.array([0.1, 0.1, 5.0])[term])
    want = np.argsort(-whole, kind="stable")[:10]
    assert best.tolist() == want.tolist() and np.allclose(score, whole[want], atol=1e-6)
    assert scored < 60


def test_blocks_are_skipped_by_their_bounds():
    """With a threshold known before, postings of low impact bring no candidates."""
    n = 10_000
    impact = np.linspace(2, 0, n)
    shard = pruned.Shard(np.arange(n), np.zeros(n, int), impact, n, 1)
    best, _, scored = shard.best(np.array([0]), np.array([1.0]), 10, float(impact[9]), np.arange(n))
    assert best.tolist() == list(range(10)) and scored <= pruned.BLOCK


def test_no_documents_or_queries(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "qid int, text string")
    split = F.split("text", " ")
    assert pruned.top_k(d.limit(0), "doc_id", split, q, "qid", split, [(pruned.OKAPI, 3)]).count() == 0
    assert pruned.top_k(d, "doc_id", split, q.limit(0), "qid", split, [(pruned.OKAPI, 3)]).count() == 0
