import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lattice.llm import ppm, queries


def plain_counts(texts, order):
    """Counts of the symbol after every context of every length."""
    tree = defaultdict(Counter)
    for t in texts:
        row = [ppm.EDGE] * order + list(low(t)) + [ppm.EDGE]
        for i in range(order, len(row)):
            for k in range(order + 1):
                tree[tuple(row[i - k : i])][row[i]] += 1
    return tree


def low(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def plain_probability(tree, context, symbol):
    """Method C with exclusion, as it is written in books: walk down, leave out what was seen further up."""
    gone, p = set(), 1.0
    for k in range(len(context), -1, -1):
        seen = tree.get(tuple(context[len(context) - k :]))
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in gone}
        whole = sum(left.values()) + (len(left) if len(seen) < 256 else 0)
        if symbol in left:
            return p * left[symbol] / whole
        if left:
            p *= len(left) / whole
        gone |= set(left)
    return p / (256 - len(gone))


def texts(seed, n=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(["ab", "Abra", "cad ", "ñ", "x", "the ", "日", "\n"]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def trie_of(rows, low_=0, high=1 << 16):
    grams = ppm.contexts(*flat_low(rows))[0]
    keys, n = np.unique(grams, return_counts=True)
    pairs = np.unique(grams & ppm._mask(1), return_counts=True)
    pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    own = (pair >= low_) & (pair < high)
    return ppm.Trie(pairs, keys[own], n[own], low_, high)


def flat_low(rows):
    data, offsets = ppm.flat(pa.array(rows, pa.string()))
    return ppm.lowered(data), offsets


@pytest.mark.parametrize("seed", range(4))
def test_code_lengths_are_those_of_the_plain_walk(seed):
    trained, asked = texts(seed), [*texts(seed + 100), "", None, "zz", "AB" * 50, "\x00\x7f"]
    tree, trie = plain_counts(trained, ppm.ORDER), trie_of(trained)
    found = trie.code_lengths(pa.array(asked, pa.string())) / ppm.SCALE
    for bits, t in zip(found, asked, strict=True):
        row = [ppm.EDGE] * ppm.ORDER + list(low(t)) + [ppm.EDGE]
        want = -sum(math.log2(plain_probability(tree, row[i - ppm.ORDER : i], row[i])) for i in range(ppm.ORDER, len(row)))
        assert bits == pytest.approx(want, abs=len(row) / ppm.SCALE)


def test_probabilities_of_all_symbols_sum_to_one():
    trie = trie_of(texts(7))
    rng = random.Random(1)
    for _ in range(50):
        context = [rng.choice([*b"abcdrx the", 0xFF, 0xC3, 0x00]) for _ in range(ppm.ORDER)]
        base = 0
        for c in context:
            base = base << 8 | c
        grams = np.array([base << 8 | s for s in range(256)], np.uint64)
        assert sum(2.0 ** (-trie.walk(grams) / ppm.SCALE)) == pytest.approx(1, abs=1e-3)


def test_every_symbol_seen_leaves_no_escape():
    every = np.arange(256, dtype=np.uint64)
    grams = np.sort(np.concatenate([every, (np.uint64(7) << np.uint64(8)) | every[:9]]))
    pairs = np.unique(grams & ppm._mask(1), return_counts=True)
    trie = ppm.Trie(pairs, grams, np.ones(len(grams), np.int64))
    assert sum(2.0 ** (-trie.walk(every) / ppm.SCALE)) == pytest.approx(1, abs=1e-3)
    assert sum(2.0 ** (-trie.walk((np.uint64(7) << np.uint64(8)) | every) / ppm.SCALE)) == pytest.approx(1, abs=1e-3)


def test_without_training_every_byte_costs_eight_bits():
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    trie = ppm.Trie(none, *none)
    assert (trie.code_lengths(pa.array(["abc", ""])) / ppm.SCALE).tolist() == [32, 8]


def test_parts_add_up():
    rows, asked = texts(3), pa.array([*texts(50), ""])
    whole = trie_of(rows).code_lengths(asked)
    cuts = [0, 0x2061, 0x6162, 0xC3B1, 1 << 16]
    assert sum(trie_of(rows, a, b).code_lengths(asked) for a, b in zip(cuts, cuts[1:], strict=False)).tolist() == whole.tolist()


def plain_base(rows, fold):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 if fold else False for i, _ in rows]
    tokens = [[*low(t).split(), None] for _, t in rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    whole = sum(counts.values()) + 0.5 * (len(counts) + 1)
    return [(i, h, len(ws), sum(counts[w] > 0 for w in ws), sum(counts.values()), sum(math.log10((counts[w] + 0.5) / whole) for w in ws)) for (i, _), h, ws in zip(rows, held, tokens, strict=True)]


@pytest.mark.parametrize("frequent", [1 << 20, 50, 1])
def test_query_has_the_plain_base_and_learns(spark, sf_dir, monkeypatch, frequent):
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 100_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in queries.queries()["op11_ppm_score"](spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for i, held, n, known, train, base in plain_base(docs, True):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    unseen = [r for r in found.values() if r.held_out and r.n_tokens > 50]
    assert np.mean([r.bits_per_byte for r in unseen]) < 3.2


def test_odd_rows_and_parts_of_the_trie(spark, odd, empty):
    trained = ppm.train(odd)
    one = sorted(map(repr, ppm.score_documents(odd, trained).collect()))
    parted = ppm.train(odd, part_grams=50)
    assert len(parted.parts) > 3
    assert sorted(map(repr, ppm.score_documents(odd, parted).collect())) == one
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in ppm.score_documents(odd, trained).collect())
    assert got == sorted((i or -1, n, k, round(b, 6)) for i, _, n, k, _, b in plain_base(rows, False))
    assert ppm.score_documents(empty, trained).count() == 0
    blind = ppm.score_documents(odd, ppm.train(empty)).collect()
    assert {round(r.score / math.log10(2)) % 8 for r in blind} == {0} and {r.base_score for r in blind} == {0.0}
