import hashlib
import random
import zlib

import numpy as np
import pytest

from lattice.llm import queries, runs


def plain_runs(words):
    """Every maximal stretch by its definition: for each period, stretches of words equal to the word a period before."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                found.setdefault((s, i + q), q)  # periods rise: the smallest comes first
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(i, text, tails=True):
    words = [] if text is None else [w for w in text.encode().split()]
    n, h = len(words), zlib.crc32(b"" if i is None else str(i).encode())
    if tails and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def coded(texts):
    codes, firsts = [], [0]
    for t in texts:
        codes += [(len(firsts) << 20) + c for c in t]
        firsts.append(len(codes))
    return np.array(codes, np.int64), np.array(firsts)


@pytest.mark.parametrize("seed", range(60))
def test_runs_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        t = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 11, 12, 13, 40, 90]))]
        if rng.random() < 0.5:
            t += (t[-rng.randrange(1, 9) :] or [0]) * rng.randrange(1, 9)
        texts.append(t)
    codes, firsts = coded(texts)
    start, length, period = runs.find_runs(codes, firsts)
    doc = np.searchsorted(firsts, start, "right") - 1
    for d, t in enumerate(texts):
        own = doc == d
        assert list(zip((start[own] - firsts[d]).tolist(), length[own].tolist(), period[own].tolist(), strict=True)) == plain_runs(t)


def test_extensions_are_counted():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 300):
        codes = rng.integers(0, 3, n)
        ext = runs.Extensions(codes)
        if n < 2:
            continue
        a, b = rng.integers(0, n, (2, 200))
        a, b = a[a != b], b[a != b]
        want = []
        for x, y in zip(a, b, strict=True):
            k = 0
            while max(x, y) + k < n and codes[x + k] == codes[y + k]:
                k += 1
            want.append(k)
        assert ext.of(a, b).tolist() == want


def test_range_minima():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 50, 200).astype(np.int32)
    low = rng.integers(0, 200, 500)
    high = np.minimum(199, low + rng.integers(0, 120, 500))
    assert runs.range_minima(values, low, high).tolist() == [int(values[x : y + 1].min()) for x, y in zip(low, high, strict=True)]


def test_small_blocks_of_the_grid_change_nothing(monkeypatch):
    codes, firsts = coded([[1, 2, 3] * 9, [4] * 30, list(range(50)) * 3])
    whole = [x.tolist() for x in runs.find_runs(codes, firsts)]
    monkeypatch.setattr(runs, "GRID_PAIRS", 5)
    assert [x.tolist() for x in runs.find_runs(codes, firsts)] == whole


def test_query_equals_the_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in queries.queries()["op13_periodic_runs"](spark, sf_dir).collect()}
    for r in docs:
        if len((r.text or "").split()) < 1500:
            assert found[r.doc_id] == plain_row(r.doc_id, r.text)
    assert len(found) == len(docs)


def test_odd_rows(odd, empty):
    rows = [tuple(r) for r in runs.periodic_runs(odd, tails=True, keep_text=False).collect()]
    want = [plain_row(r.doc_id, r.text) for r in odd.collect() if r.text is None or len(r.text) < 20_000]
    assert all(w in rows for w in want) and len(rows) == odd.count()
    assert runs.periodic_runs(empty).count() == 0


def test_texts_and_runs_come_along(spark):
    docs = spark.createDataFrame([(1, "a b c " * 6 + "z")], "doc_id int, text string")
    row = runs.periodic_runs(docs).first()
    assert row.collapsed_text == "a b c z" and [tuple(r) for r in row.runs] == [(0, 18, 3)]
