"""Secret scan: three fixed patterns, and random strings found by two character Markov models."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import map_arrow, slices

KINDS = ("assign", "access", "hex", "random")
#: Strings of each alphabet that are generated as labelled random samples, beside those that the corpus labels.
GENERATED = 2000
#: Mean log-likelihood ratio a character, in nats, from which on a string counts as random.
THRESHOLD = 0.7


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# Fixed patterns.
_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the models judge: long runs of these characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What the models learn as ordinary: runs of these characters of 6 or more outside every fixed pattern.
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")

# Classes of characters: one for each of the alphabet, and one for both ends of a string.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SIZE = len(_ALPHABET) + 1
_CLASS = np.zeros(128, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CLASS[ord(_c)] = _i + 1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, secret) of the fixed patterns, leftmost and non-overlapping for each kind, in code points."""
    out = [(m.start(), m.end(), 0, m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), m.end(), 1, m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m.group()) for m in HEX.finditer(text)]
    out.sort(key=lambda s: s[:3])
    return out


def pair_counts(strings: list[str]) -> np.ndarray:
    """Counts of neighbouring character classes over all strings, ends included, as a flat square matrix."""
    joined = np.frombuffer(("\n" + "\n".join(strings) + "\n").encode("ascii", "replace"), np.uint8)
    classes = _CLASS[np.minimum(joined, 127)]
    return np.bincount(classes[:-1] * _SIZE + classes[1:], minlength=_SIZE * _SIZE)


@dataclass(frozen=True)
class LikelihoodRatio:
    """log P(next | previous) under random strings less that under each kind of ordinary identifiers."""

    weights: np.ndarray
    threshold: float

    @classmethod
    def fit(cls, random_counts: np.ndarray, *ordinary_counts: np.ndarray, threshold: float) -> LikelihoodRatio:
        def log_probability(counts: np.ndarray) -> np.ndarray:
            square = counts.reshape(_SIZE, _SIZE).astype(float)
            unigram = (square.sum(0) + 1.0) / (square.sum() + _SIZE)
            # a row backs off to the unigram by ten virtual counts
            return np.log((square + 10.0 * unigram) / (square.sum(1, keepdims=True) + 10.0))

        return cls(np.stack([log_probability(random_counts) - log_probability(c) for c in ordinary_counts]), threshold)

    def score(self, value: str) -> float:
        """Mean log-likelihood ratio a character of a string over the alphabet, against the kind that explains it best."""
        classes = _CLASS[np.frombuffer(("\n" + value + "\n").encode("ascii"), np.uint8)]
        return float(self.weights[:, classes[:-1], classes[1:]].sum(1).min() / len(value))


def generated_samples(n: int = GENERATED, seed: int = 5) -> list[str]:
    """Labelled random strings of the usual alphabets of keys and digests."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", _ALPHABET[:26] + "234567", _ALPHABET[:62], _ALPHABET[:62] + "+/", _ALPHABET[:62] + "-_")
    return ["".join(rng.choices(a, k=rng.randint(16, 48))) for a in alphabets for _ in range(n)]


#: Words that names in programs, paths and addresses are put together from.
NAME_WORDS = (
    "account action active add address admin agent alert all api app apply array asset async auth author auto back base batch bean block body book boot border bottom box branch brand build bundle button by cache call case "
    "category cell change channel check child city class clean clear click client clone close cloud cluster code color column comment common complete component config connect content context control cookie copy core count "
    "country create current customer daily data date day debug default delete demo detail device dir disk display doc document down draft driver edit element email empty enable end engine entity entry error event export "
    "factory file filter find first font footer form format from front full function get global graph grid group handle hash header help history home host hour html icon id image import index info init input insert install "
    "instance internal is item java job join key label lang last layout left level lib library line link linux list load local log login main make manager map master max media menu message method min mobile mode model month "
    "name native net new next node note number object on open option order output owner package page panel parent parse part path payment people phone photo plan player policy pool position post price print private process "
    "product profile project proxy public query queue read record ref region register release remote remove render report request reset resource response result return right role root route rule run sample save schema screen "
    "script search section select send server service session set share shop show simple single site size sort source spec stack start state static status step stop storage store stream string style submit success system tab "
    "table tag target task team temp template test text theme thread time title to tool top total track tree type update upload url user util valid value var vector version video view visible web widget window work worker wrapper write year zone"
).split()


def ordinary_samples(n: int = 4 * GENERATED, seed: int = 6, words: Sequence[str] = NAME_WORDS) -> list[str]:
    """Labelled ordinary identifiers: camel, snake and kebab case, constants, paths, addresses, assignments, names with numbers, dates and versions."""
    rng = random.Random(seed)

    def pick(most: int) -> list[str]:
        return [rng.choice(words) for _ in range(rng.randint(2, most))]

    number = lambda: str(rng.randrange(10 ** rng.randint(1, 4)))
    forms = (
        lambda: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(pick(6))), lambda: "".join(w.capitalize() for w in pick(6)), lambda: "_".join(pick(6)), lambda: "_".join(pick(6)).upper(),
        lambda: "-".join(pick(6)), lambda: "/" + "/".join(pick(7)), lambda: "/".join(pick(7)), lambda: "/".join([*pick(5), number()]), lambda: "/".join([*pick(4), f"{rng.randint(1990, 2030)}", f"{rng.randint(1, 12):02}"]),
        lambda: "/".join("-".join(pick(3)) for _ in range(rng.randint(2, 4))), lambda: "/".join("_".join(pick(3)) for _ in range(rng.randint(2, 4))), lambda: "/".join([*pick(4), "".join(w.capitalize() for w in pick(4))]),
        lambda: "_".join([*pick(5), number()]), lambda: f"{'-'.join(pick(4))}-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.choice(words)}={'_'.join(pick(4))}",
        lambda: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(pick(4))) + number(), lambda: "".join(pick(5)),
    )
    return [rng.choice(forms)() for _ in range(n)]


def train(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> LikelihoodRatio:
    """Count character pairs of the whole corpus: the secrets of the fixed patterns and generated strings are the
    random samples, all other identifiers are one kind of ordinary ones, put-together names the other. Every task returns the cells it has seen; the sums are
    two matrices of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, _SIZE * _SIZE), np.int64)
        for batch in slices(batches, 0):
            secrets, ordinary = [], []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                secrets += [s for *_, s in spans]
                if spans:
                    parts, at = [], 0
                    for start, end, *_ in spans:
                        if start > at:
                            parts.append(text[at:start])
                        at = max(at, end)
                    text = "\n".join([*parts, text[at:]])
                ordinary += ORDINARY.findall(text)
            totals[0] += pair_counts(secrets)
            totals[1] += pair_counts(ordinary)
        label, cell = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(cell), pa.array(totals[label, cell])], ["label", "cell", "n"])

    counts = map_arrow(docs.select(text_col), count, "label long, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    both = np.zeros((2, _SIZE * _SIZE), np.int64)
    for row in counts.collect():  # at most two matrices of _SIZE x _SIZE cells
        both[row.label, row.cell] = row.n
    both[0] += pair_counts(generated_samples())
    return LikelihoodRatio.fit(both[0], both[1], pair_counts(ordinary_samples()), threshold=threshold)


def model_spans(text: str, base: list[tuple[int, int, int, str]], model: LikelihoodRatio) -> list[tuple[int, int, int, str]]:
    """Candidates that look random by the models and touch no fixed pattern."""
    out = []
    for m in CANDIDATE.finditer(text):
        value = m.group()
        if any(s[0] < m.end() and m.start() < s[1] for s in base):
            continue
        if model.score(value) >= model.threshold:
            out.append((m.start(), m.end(), 3, value))
    return out


def joined_spans(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in spans)


def redacted(text: str, spans: list[tuple[int, int, int, str]], mark: str = "<secret>") -> str:
    """Replace the union of the spans."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for start, end, *_ in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        parts += [text[at:start], mark]
        at = end
    return "".join(parts) + text[at:]


def scan_secrets(docs: DataFrame, model: LikelihoodRatio | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redact: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random and the list ``found``.

    Without ``model`` one is trained on ``docs`` itself (one more pass). Spans count code points, the end exclusive;
    fixed kinds come first where starts tie. A null text counts as empty: no spans, the digest of nothing. Repeated
    rows and null ids pass through. ``keep`` names further columns to pass on (as ``keep_<name>`` where the result has that
    name already); ``redact`` adds ``redacted``, the text
    with the union of all spans replaced (null stays null). Other columns, whatever their names, are not read. An
    empty table gives no rows.
    """
    judge = model or train(docs, text_col=text_col)
    extra = [c for c in keep if c != id_col]
    passed = T.StructType([T.StructField(f"_keep{i}", docs.schema[c].dataType) for i, c in enumerate(extra)])
    item = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)])
    for name, kind in (("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_random", T.LongType()), ("found", item)):
        schema = schema.add(name, kind)
    if redact:
        schema = schema.add("redacted", T.StringType())
    for field in passed:
        schema = schema.add(field)
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in slices(batches, 1):
            counts, digests, spans, found, clean = ([], [], [], []), [], [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                every = base + (model_spans(text, base, judge) if text else [])
                every.sort(key=lambda s: s[:3])
                for k in range(4):
                    counts[k].append(sum(s[2] == k for s in every))
                digests.append(hashlib.sha256(joined_spans(base).encode()).hexdigest() if base else empty)
                spans.append(joined_spans(every))
                found.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k, _ in every])
                if redact:
                    clean.append(redacted(text, every) if every else text)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64()), pa.array(found, found_type)]
            arrays += [pa.array(clean, pa.string())] if redact else []
            arrays += batch.columns[2:]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    out = map_arrow(docs.select(F.col(id_col), F.col(text_col), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(extra))), scan, schema)
    own = [c for c in schema.names if not c.startswith("_keep")]
    return out.select(*own, *(F.col(f"_keep{i}").alias(f"keep_{c}" if c in own else c) for i, c in enumerate(extra)))
