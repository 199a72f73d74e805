import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattice.llm import phrases


def plain(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        best = []
        for w, a in candidates.items():
            score, cut = min((2000000 * a // (f[w[:c]] + f[w[c:]]), c) for c in range(1, len(w)))
            if any(len(v) > len(w) and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for v, b in candidates.items()):
                continue
            best.append((-score, -a, " ".join(w).encode(), f[w[:cut]], f[w[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["of", "the", "New", "York", "city", "état", "x", "long-winded-compound-word", "日本", "z q"]
    weights = [8, 8, 3, 3, 2, 2, 1, 1, 1, 1]
    out = []
    for _ in range(n):
        run = []
        while len(run) < rng.randrange(1, 60):
            run += rng.choice([["New", "York", "city", "hall"], ["state", "of", "the", "art"], rng.choices(words, weights, k=3)])
        out.append((rng.choice(["en", "de", None, ""]), "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for w in run)))
    return [*out, ("en", None), (None, ""), ("en", " \t\n.,"), ("en", "a " * 500)]


@pytest.mark.parametrize(("seed", "bits", "least", "top"), [(1, 26, 30, 2000), (2, 5, 10, 2000), (3, 17, 3, 7), (4, 26, 300, 50)])
def test_equal_to_counting_everything(spark, monkeypatch, seed, bits, least, top):
    monkeypatch.setattr(phrases, "BUCKET_BITS", bits)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 700)
    monkeypatch.setattr(phrases, "HELD", 40)
    rows = texts(seed)
    docs = spark.createDataFrame([(t, lang, 1) for lang, t in rows], "text string, lang string, n int").repartition(3)
    found = sorted(tuple(r) for r in phrases.mine_phrases(docs, least=least, top=top).collect())
    assert found == plain(rows, least, 4, top)


def test_buckets_and_apriori_prune(spark):
    """Only runs whose parts are frequent and whose buckets are full are counted: far fewer than there are."""
    rng = random.Random(9)
    rows = [("en", " ".join(["good", "morning"] + [f"w{rng.randrange(10**6)}" for _ in range(50)])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    picked = docs.select("lang", "text")
    first = phrases.written(phrases._counted(picked, 1, 30, False, None), "t1")
    tables, _ = phrases.frequent_phrases(docs)
    shared = tuple(spark.sparkContext.broadcast(b) for b in (phrases._frequent_bits(tables[0]), phrases._bits(first, 30)))
    second = phrases._counted(picked, 2, 30, False, shared).where("chunk is null")
    assert [(r.phrase, r.n) for r in second.groupBy("phrase").sum("n").toDF("phrase", "n").collect()] == [("good morning", 60)]
    assert [t.count() for t in tables] == [2, 1, 0, 0]


def test_counts_beyond_a_byte_stay_whole(spark):
    docs = spark.createDataFrame([("en", "to be or " * 4000)], "lang string, text string")
    row = phrases.mine_phrases(docs, least=1000).first()
    assert tuple(row) == ("en", 1, "be or to be", 3999, 4000, 4000, 12000, 999750)
    assert phrases._kind(1000) is np.uint32


def test_odd_rows(odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in phrases.mine_phrases(odd).collect()) == plain(rows, 30, 4, 2000)
    assert phrases.mine_phrases(empty).count() == 0
