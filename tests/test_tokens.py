import random

import pytest
import tiktoken

from lattice.functions import tokens
from lattice.plans import registry

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_windows(text, most, count, overlap=0.1):
    """Halving over counts of whole prefixes."""
    if not text:
        return [(0, 0)]
    if count(text) <= most:
        return [(0, len(text))]
    out, start = [], 0
    while start < len(text):
        low, high, best = start + 1, len(text), start
        while low <= high:
            middle = (low + high) // 2
            if count(text[start:middle]) <= most:
                best, low = middle, middle + 1
            else:
                high = middle - 1
        out.append((start, best))
        if best == len(text):
            break
        start = max(start + 1, best - max(1, int((best - start) * overlap)))
    return out


def odd_text(rng):
    return "".join(rng.choice(["word", " and", "  ", "\n\n ", "日本語", "é", "😀", "'s", " 1234", "!!", "\t", "Zz"]) for _ in range(rng.randrange(0, 120)))


def test_merges_equal_the_library(ranks, library, spark, sf_dir):
    counter, rng = tokens.Counter(ranks), random.Random(2)
    for _ in range(200):
        text = odd_text(rng)
        assert [t for m in counter.split.findall(text) for t in tokens.merged(m.encode(), ranks)] == library.decode_tokens_bytes(library.encode_ordinary(text))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r.doc_id: r.n_tokens for r in registry.queries()["token_counts"](spark, sf_dir).collect()}
    assert found == {i: len(library.encode_ordinary(t or "")) for i, t in texts.items()}


@pytest.mark.parametrize("most", [1, 3, 10, 37])
def test_windows_equal_halving_over_whole_prefixes(ranks, library, most):
    counter, rng = tokens.Counter(ranks), random.Random(most)
    count = lambda t: len(library.encode_ordinary(t))
    for _ in range(40):
        text = odd_text(rng).replace("😀", "").replace("日本語", "") if most < 4 else odd_text(rng)
        found = list(counter.windows(text, most))
        assert [(a, b) for a, b, _ in found] == plain_windows(text, most, count)
        assert all(n == count(text[a:b]) <= most for a, b, n in found)


def test_windows_of_documents(spark, sf_dir, library):
    rows = registry.queries()["token_windows"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.window)):
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for i, own in by.items():
        assert all(r.n_tokens <= 512 and texts[i][r.start : r.start + len(r.text)] == r.text for r in own)
        assert own[0].start == 0 and own[-1].start + len(own[-1].text) == len(texts[i])
        assert all(a.start < b.start <= a.start + len(a.text) for a, b in zip(own, own[1:], strict=False))


def test_a_character_beyond_the_budget(ranks):
    with pytest.raises(ValueError, match="single character"):
        list(tokens.Counter(ranks).windows("日本語 " * 9, 1))
