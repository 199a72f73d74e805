import random

import pytest

#: Texts that every operator has to live with: null, empty, blank, short, long, repeated, odd white space, other scripts.
WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(11)
    long = sentence(rng, 6000)
    base = sentence(rng, 60)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, None), (4, "one", "fr", "b"), (5, long, "en", "a"), (6, long, "en", "a"),
        (7, base, "en", "a"), (7, base, "en", "a"), (8, base + " extra", "de", None), (9, "日本語 текст ñ  x\u00a0y\u2003z\x1c q", "ja", "c"), (10, "12 34 !!", None, "c"),
        (None, base, "en", "a"), (None, None, None, None), (11, "é" * 700, "fr", "b"), (12, "\n".join(["same line here"] * 9), "en", "b"), (13, "𝔘𝔫𝔦 😀 " * 40, "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "x", 1.5) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Odd rows with extra columns whose names operators use for their own output."""
    return spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
