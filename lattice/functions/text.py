"""Text expressions: tokens, normalisers, scores, hashes, parsers. Columns in, columns out; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of URL names in version-5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
_CJK = "\\u4e00-\\u9fff"


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def _grams_of(run: Column, sizes: tuple[int, ...]) -> Column:
    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1)))
        return F.when(F.length(run) >= n, F.transform(starts, lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(grams, sizes))


# Words that ask and don't name anything.
STOP_WORDS = ("是谁", "什么", "怎么", "如何", "以及", "一个", "这个", "那个", "请问")


def query_terms(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Sorted distinct terms of a query without stop words: words, Chinese runs of at most 8 characters whole, and their 2- to 4-grams."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"[{_CJK}]+"), F.lit(0))
    short = F.filter(runs, lambda r: F.length(r) <= 8)
    grams = F.flatten(F.transform(runs, lambda r: _grams_of(r, (2, 3, 4))))
    every = F.array_sort(F.array_distinct(F.concat(words(text), short, grams)))
    return F.filter(every, lambda t: (t != "") & ~t.isin(list(stop))) if stop else F.filter(every, lambda t: t != "")


def bigram_terms(text: Column) -> Column:
    """Words and bigrams of ideograph runs (a single character stays)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[\\u3400-\\u9fff]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(_grams_of(r, (2,)))))
    return F.concat(words(text), grams)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    return F.when(F.length(term) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


def substring_score(content: Column, metadata: Column, query: Column, terms: Column) -> Column:
    """40 for the whole query in the content, 20 in the metadata; each term adds 10 + min(tf, 5) and 5 + min(tf, 3)."""
    return lower_score(F.lower(content), F.lower(metadata), F.lower(F.trim(query)), terms)


def lower_score(c: Column, m: Column, q: Column, terms: Column) -> Column:
    """The substring score of texts in lower case. Where many terms meet one text, fold its case in a step before: a lambda would do it for each term."""
    whole = F.when((q != "") & F.contains(c, q), 40).otherwise(0) + F.when((q != "") & F.contains(m, q), 20).otherwise(0)

    def term_score(acc: Column, t: Column) -> Column:
        in_content = F.when(F.contains(c, t), 10 + F.least(occurrences(c, t), F.lit(5))).otherwise(0)
        return acc + in_content + F.when(F.contains(m, t), 5 + F.least(occurrences(m, t), F.lit(3))).otherwise(0)

    return whole + F.aggregate(F.filter(terms, lambda t: t != ""), F.lit(0), term_score)


# The word of a question for a person, and the terms of a profile that answers it.
WHO = "谁"
PROFILE_TERMS = ("负责人", "研究员", "博士", "工作经历", "教育背景", "研究方向", "任职")


def chunk_relevance(content: Column, metadata: Column, path: Column, query: Column, terms: Column) -> Column:
    """The substring score; 1 more for a node, 4 for each profile term where the question asks who, .5 less for more than 3000 characters."""
    return substring_score(content, metadata, query, terms) + relevance_extra(content, path, query)


def relevance_extra(content: Column, path: Column, query: Column) -> Column:
    return relevance_bonus(content, path) + F.when(F.contains(query, F.lit(WHO)), profile_bonus(content)).otherwise(0)


def relevance_bonus(content: Column, path: Column) -> Column:
    """What a chunk's own place and length add, whatever the question."""
    return F.when(path.startswith("node:"), 1.0).otherwise(0.0) - F.when(F.length(content) > 3000, 0.5).otherwise(0.0)


def profile_bonus(content: Column) -> Column:
    """What the profile terms of a chunk add where the question asks who."""
    out = F.lit(0)
    for term in PROFILE_TERMS:
        out = out + F.when(F.contains(content, F.lit(term)), 4).otherwise(0)
    return out


def coverage_relevance(text: Column, query: Column) -> Column:
    """98 if the compact text holds the compact query, else up to 92 by the share of its bigrams that it holds."""
    compact = lambda c: F.regexp_replace(F.lower(c), "\\s+", "")
    t, q = compact(text), compact(query)
    grams = F.array_distinct(_grams_of(q, (2,)))
    hits = F.size(F.filter(grams, lambda g: F.contains(t, g)))
    share = F.when(F.size(grams) > 0, hits / F.size(grams)).otherwise(0.0)
    return F.when(F.length(q) == 0, 0.0).when(F.contains(t, q), 98.0).otherwise(F.least(F.lit(92.0), F.bround(share * 100, 1)))


def loose(text: Column) -> Column:
    """Lower case without white space, dots, dashes, underscores and brackets (``lower`` stands in for full case folding)."""
    return F.regexp_replace(F.lower(text), "[\\s._\\-–—()\\[\\]（）【】《》]+", "")


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def sentences(text: Column) -> Column:
    """Pieces that end after a sentence mark, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, "(?<=[。！？；.!?;])"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def half_width(text: Column) -> Column:
    """Full-width forms and the ideographic space to their ASCII twins."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    narrow = "".join(chr(0x21 + i) for i in range(94)) + " "
    return F.translate(text, wide, narrow)


def escape_cell(text: Column) -> Column:
    """A Markdown table cell: pipes escaped, line feeds as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\|", "\\\\|"), "\\s*\\n\\s*", " "))


def token_estimate(text: Column) -> Column:
    """One token for four characters, at least one unless empty: the fallback of an exact counter."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def material_tokens(text: Column) -> Column:
    return F.greatest(F.ceil(F.length(text) / 4), F.ceil(F.octet_length(text) / 3))


def uuid5_of_sha256(text: Column) -> Column:
    """The version-5 UUID of the URL name ``sha256:<digest>``."""
    name = F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.concat(F.lit("sha256:"), F.sha2(text, 256)).cast("binary"))
    h = F.sha1(name)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def page_numbers(expression: Column) -> Column:
    """Sorted distinct numbers of ``1,3-5,8``; reversed ranges are swapped, parts that are no numbers left out."""
    parts = F.filter(F.transform(F.split(expression, ","), lambda p: F.trim(p)), lambda p: p.rlike("^\\d+(\\s*-\\s*\\d+)?$"))

    def expand(p: Column) -> Column:
        ends = F.split(p, "\\s*-\\s*")
        a, b = F.element_at(ends, 1).cast("int"), F.element_at(ends, -1).cast("int")
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def capped_pages(expression: Column, most: int = 8) -> Column:
    return F.array_join(F.transform(F.slice(page_numbers(expression), 1, most), lambda n: n.cast("string")), ",")


def number_literals(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("\\d+(\\.\\d+)?"), F.lit(0))))


def quote_window(text: Column, terms: Column, width: int = 160) -> Column:
    """``width`` characters around the first place of the first term that occurs, ellipses where text is cut."""
    t = F.trim(F.regexp_replace(text, "\\s+", " "))
    low = F.lower(t)
    hit = F.filter(terms, lambda w: F.contains(low, w))
    at = F.when(F.size(hit) > 0, F.instr(low, F.get(hit, F.lit(0)))).otherwise(1)
    start = F.greatest(F.lit(1), at - width // 2)
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(t, start, F.lit(width)), F.when(start + width - 1 < F.length(t), "…").otherwise(""))


def clock_seconds(text: Column) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or units of hours, minutes and seconds; else null."""
    part = lambda pattern, g: F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).cast("double")
    hms, ms = "^\\s*(\\d+):(\\d+):(\\d+(?:\\.\\d+)?)\\s*$", "^\\s*(\\d+):(\\d+(?:\\.\\d+)?)\\s*$"
    h, m, s = part("(\\d+(?:\\.\\d+)?)\\s*(?:小时|时|hours?|h)", 1), part("(\\d+(?:\\.\\d+)?)\\s*(?:分钟|分|min(?:ute)?s?|m(?![a-z]))", 1), part("(\\d+(?:\\.\\d+)?)\\s*(?:秒|sec(?:ond)?s?|s(?![a-z]))", 1)
    units = F.coalesce(h, F.lit(0.0)) * 3600 + F.coalesce(m, F.lit(0.0)) * 60 + F.coalesce(s, F.lit(0.0))
    return F.when(text.rlike(hms), part(hms, 1) * 3600 + part(hms, 2) * 60 + part(hms, 3)).when(text.rlike(ms), part(ms, 1) * 60 + part(ms, 2)).when(h.isNotNull() | m.isNotNull() | s.isNotNull(), units)


def subtitle_time(seconds: Column, separator: str = ",") -> Column:
    """``hh:mm:ss,mmm``, rounded to milliseconds."""
    ms = F.bround(seconds * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(separator), F.lpad((ms % 1000).cast("string"), 3, "0"))


def strip_html(html: Column) -> Column:
    """Text of a page: comments, scripts, styles and tags out, the common entities read, white space collapsed."""
    t = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?is)<(script|style)\\b.*?</(script|style)>", " ")
    t = F.regexp_replace(t, "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, "[ \\t\\n\\r]+", " "))


def stop_word_language(text: Column) -> Column:
    """The language whose common short words stand most often in the text (a stand-in for a detector model), first by name on ties, else und."""
    lists = {
        "de": ("der", "die", "und", "das", "ist", "nicht", "den", "zu", "mit", "von"),
        "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "as"),
        "es": ("el", "los", "que", "en", "del", "las", "por", "con", "una", "se"),
        "fr": ("le", "les", "et", "des", "est", "la", "une", "dans", "pour", "du"),
    }
    # one search finds the words of all lists; lambdas over arrays of one hold what is found and its counts, so nothing is done again for each use
    letter = "[a-zà-öø-ÿ]"
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?<!{letter})(?:{'|'.join(w for ws in lists.values() for w in ws)})(?!{letter})"), F.lit(0))
    counts = F.transform(F.array(found), lambda f: F.array(*(F.size(F.filter(f, lambda t: t.isin(list(ws)))) for ws in lists.values())))

    def guess(n: Column) -> Column:
        out = F.when(F.array_max(n) == 0, F.lit("und"))
        for i, lang in enumerate(lists):
            out = out.when(n[i] == F.array_max(n), lang)
        return out

    return F.transform(counts, guess)[0]
