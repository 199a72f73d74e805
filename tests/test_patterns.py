import random

import pytest
from pyspark.sql import functions as F

from lattice.operators import patterns


def plain_count(text, term):
    return (len(text) - len(text.replace(term, ""))) // len(term)


def plain(docs, queries, k):
    out = []
    for q, phrase, terms, flag in queries:
        scored = []
        for i, c, m, bonus, extra in docs:
            c, m = c or "", m or ""
            s = (40 if phrase and phrase in c else 0) + (20 if phrase and phrase in m else 0) + bonus + (extra if flag else 0)
            for t in dict.fromkeys(t for t in terms or () if t):
                s += (10 + min(plain_count(c, t), 5) if t in c else 0) + (5 + min(plain_count(m, t), 3) if t in m else 0)
            if s > 0:
                scored.append((-s, i))
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("characters", "texts"), [(500_000, 256), (30, 3)])
def test_equal_to_searching_each_term(spark, monkeypatch, characters, texts):
    monkeypatch.setattr(patterns, "PATTERN_CHARACTERS", characters)
    monkeypatch.setattr(patterns, "TEXTS", texts)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("aab bé日 ") for _ in range(n))
    docs = [(i, None if i == 7 else text(rng.choice([0, 5, 60])), rng.choice(["a", "bb", None]), float(i % 2), float(i % 3)) for i in range(60)]
    queries = [(q, rng.choice(["", "a a", text(3)]), [text(rng.randrange(0, 4)) for _ in range(4)], q % 2 == 0) for q in range(9)] + [(20, None, None, False)]
    d = spark.createDataFrame(docs, "doc_id long, c string, m string, b double, f double").repartition(3)
    q = spark.createDataFrame(queries, "qid int, p string, t array<string>, flag boolean")
    found = patterns.substring_top_k(d, "doc_id", F.col("c"), F.col("m"), q, "qid", F.col("p"), F.col("t"), 5, F.col("b"), F.col("flag"), F.col("f"))
    assert sorted((r.qid, r.doc_id, r.score, r.rank) for r in found.collect()) == plain(docs, queries, 5)


def test_terms_that_overlap_themselves_count_from_the_left():
    p = patterns.Patterns.of([(1, "aba", ["aa", "a"], False)])
    count = patterns.occurrences(p.automaton(), "aaaaabab")
    assert {p.strings[i]: n for i, n in count.items()} == {"aa": 2, "a": 6, "aba": 1}


def test_no_documents_or_queries(spark):
    d = spark.createDataFrame([(1, "a", "b")], "doc_id long, c string, m string")
    q = spark.createDataFrame([(1, "a", ["a"])], "qid int, p string, t array<string>")
    for docs, queries in ((d.limit(0), q), (d, q.limit(0))):
        assert patterns.substring_top_k(docs, "doc_id", F.col("c"), F.col("m"), queries, "qid", F.col("p"), F.col("t"), 3).count() == 0
