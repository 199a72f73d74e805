"""Shaping of text that needs more than an expression: normal forms, scored splits, similarity. Arrow batches, not rows."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nfkc(text: Column) -> Column:
    """Compatibility composition. ASCII texts, which it leaves alone, never reach Python."""
    udf = F.pandas_udf(lambda s: s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore"), T.StringType())
    plain = ~text.rlike("[^\\x00-\\x7f]")
    return F.when(plain, text).otherwise(udf(F.when(~plain, text)))


def mixed_terms(text: Column) -> Column:
    """Ordered distinct terms of normalised text: ASCII words, ideograph runs of up to 4 whole, and their 2- and 3-grams."""
    t = F.lower(nfkc(text))
    chunks = F.regexp_extract_all(t, F.lit("[a-z0-9_]+|[\\u4e00-\\u9fff]+"), F.lit(0))

    def grams(c: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
        return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def terms(c: Column) -> Column:
        whole = F.when(F.length(c) <= 4, F.array(c)).otherwise(F.array().cast("array<string>"))
        return F.when(c.rlike("^[a-z0-9_]"), F.array(c)).otherwise(F.concat(whole, grams(c, 2), grams(c, 3)))

    return F.array_distinct(F.flatten(F.transform(chunks, terms)))


def question_key(text: Column, synonyms: Mapping[str, str], particles: Sequence[str] = ("吗", "呢", "吧", "啊")) -> Column:
    """Cache key of a question: normalised, lower case, synonyms folded, no spaces, no final marks or particles."""
    t = F.lower(nfkc(text))
    for word, other in synonyms.items():
        t = F.replace(t, F.lit(word), F.lit(other))
    return F.regexp_replace(F.regexp_replace(t, "\\s+", ""), f"(?:[?？!！。.,，;；]|{'|'.join(particles)})+$", "")


def script(text: Column) -> Column:
    """Soft wraps joined, paragraphs joined by 。 unless they end in a mark."""
    paragraphs = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\\n\\s*\\n")
    joined = F.filter(F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(p, "\\s*\\n\\s*", ""))), lambda p: p != "")
    marked = F.transform(joined, lambda p: F.when(p.rlike("[。！？；.!?;]$"), p).otherwise(F.concat(p, F.lit("。"))))
    return F.array_join(marked, "")


def question_parts(text: Column) -> Column:
    """Sub-questions at line feeds and sentence marks, first seen kept."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[\\n;；。！？!?]+"), lambda p: F.trim(p)), lambda p: p != ""))


def output_name(parts: Sequence[Column], extension: str) -> Column:
    return F.concat(F.regexp_replace(F.concat_ws("_", *parts), "[^A-Za-z0-9\\u4e00-\\u9fff_.-]+", "-"), F.lit(extension))


# Worth of a split behind each mark.
MARKS = {"。": 100, "！": 100, "？": 100, "；": 80, ".": 100, "!": 100, "?": 100, ";": 80, "，": 60, ",": 60, "、": 40, "：": 50, ":": 50}


def split_line(text: str, most: int, least: int, stretch: int) -> list[str]:
    """Lines of at most ``most`` characters, split at the mark that is worth most less the imbalance of the sides; a side up to ``least`` vetoes. Text without marks may reach ``stretch``, beyond that it breaks at a space or hard."""
    if len(text) <= most:
        return [text] if text else []
    options = [(MARKS[c] - abs(2 * (i + 1) - len(text)), -i) for i, c in enumerate(text) if c in MARKS and min(i + 1, len(text) - i - 1) > least]
    if options:
        cut = -max(options)[1] + 1
    elif len(text) <= stretch:
        return [text]
    else:
        space = text.rfind(" ", least, most)
        cut = space + 1 if space > 0 else most
    return split_line(text[:cut].rstrip(), most, least, stretch) + split_line(text[cut:].lstrip(), most, least, stretch)


def wrapped(text: str, width: int) -> list[str]:
    """Lines of at most ``width`` that leave quoted and bracketed spans whole where they fit."""
    pieces = re.findall(r"“[^”]*”|\([^)]*\)|（[^）]*）|\S+\s*|\s+", text)
    out, line = [], ""
    for p in pieces:
        if line and len((line + p).rstrip()) > width:
            out.append(line.rstrip())
            line = ""
        line += p
        while len(line.rstrip()) > width:
            out.append(line[:width])
            line = line[width:]
    return [*out, line.rstrip()] if line.strip() else out


def overlong(text: str, is_heading: Callable[[str], bool], least: int, most: int, nodes: int = 80) -> list[str]:
    """Parts of an overlong leaf: at headings if there are two or more (short parts joined), else at blank lines, else by length."""
    lines = text.splitlines()
    marks = [i for i, line in enumerate(lines) if is_heading(line)]
    attempts = []
    if len(marks) >= 2:
        edges = sorted({0, *marks, len(lines)})
        attempts.append(["\n".join(lines[a:b]) for a, b in zip(edges, edges[1:])])
    attempts.append(re.split(r"\n\s*\n", text))
    for parts in attempts:
        joined: list[str] = []
        for p in filter(str.strip, parts):
            if joined and len(joined[-1]) < least:
                joined[-1] += "\n" + p
            else:
                joined.append(p)
        if 1 < len(joined) <= nodes and max(map(len, joined)) <= most:
            return joined
    return [text[i : i + most] for i in range(0, len(text), most)]


def split_lines(text: Column, most: int, least: int, stretch: int) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: split_line(t or "", most, least, stretch)), T.ArrayType(T.StringType()))(text)


def similarity(a: Column, b: Column) -> Column:
    """Sequence ratio of two texts without punctuation (not an edit distance)."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        core = lambda t: re.sub(r"[^\w]+", "", t or "")
        return pd.Series([round(difflib.SequenceMatcher(None, core(p), core(q), autojunk=False).ratio(), 6) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(ratio, T.DoubleType())(a, b)


def tolerant_json(text: Column) -> Column:
    """The JSON object or array inside an answer: fences go, text before and after is left out; null where nothing parses."""
    bare = F.regexp_replace(text, "```[a-zA-Z]*", "")
    found = F.coalesce(F.nullif(F.regexp_extract(bare, "(?s)(\\{.*\\})", 1), F.lit("")), F.nullif(F.regexp_extract(bare, "(?s)(\\[.*\\])", 1), F.lit("")))
    fixed = F.regexp_replace(found, ",\\s*([}\\]])", "$1")
    return F.when(F.try_parse_json(fixed).isNotNull(), fixed)


def table_columns(html: Column) -> Column:
    """Columns of the widest row of a table: its cells, each by its colspan."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr\\b.*?</tr>"), F.lit(0))

    def width(row: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit("(?i)<t[dh]\\b[^>]*>"), F.lit(0))
        spans = F.transform(cells, lambda c: F.coalesce(F.nullif(F.regexp_extract(c, "(?i)colspan\\s*=\\s*[\"']?(\\d+)", 1), F.lit("")).cast("int"), F.lit(1)))
        return F.aggregate(spans, F.lit(0), lambda a, n: a + n)

    return F.coalesce(F.array_max(F.transform(rows, width)), F.lit(0))


def intent(text: Column, weights: Mapping[str, Sequence[tuple[str, int]]], otherwise: str) -> Column:
    """The workflow whose patterns weigh most (the first named on ties), or ``otherwise`` where none matches."""
    scores = {}
    for name, patterns in weights.items():
        scores[name] = F.lit(0)
        for pattern, weight in patterns:
            scores[name] = scores[name] + F.when(text.rlike(pattern), weight).otherwise(0)
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(best == 0, F.lit(otherwise))
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out
