"""Rules over documents, units and cues: scopes, headings, routing, trimming, sampling."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- filters ----------------------------------------------------------------------------------


def facets_like(facets: Mapping[str, str | None]) -> Column:
    """All non-blank facets stand in their columns."""
    out = F.lit(True)
    for name, value in facets.items():
        if value and value.strip():
            out = out & F.contains(F.col(name), F.lit(value.strip()))
    return out


def hard_filter(text: Column, modality: Column, modalities: Sequence[str], speakers: Sequence[str] = (), persons: Sequence[str] = (), exclusions: Sequence[str] = ()) -> Column:
    """Allowed modality, any speaker, any person, no exclusion, all as substrings of the lower-case text."""
    t = F.lower(text)

    def any_of(values: Sequence[str]) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | F.contains(t, F.lit(v.lower()))
        return out

    keep = modality.isin(list(modalities))
    keep = keep & any_of(speakers) if speakers else keep
    keep = keep & any_of(persons) if persons else keep
    return keep & ~any_of([e for e in exclusions if e])


def scope(duration: Column, kind: Column, start: Column, end: Column, text_start: Column | None = None, text_end: Column | None = None) -> Column:
    """Struct of start, end, duration, narrow and empty: a quick scope by name, cut with the times a text names.

    Opening and ending are 15 % of the duration, 600 seconds at most; halves, and the middle from 25 % to 75 %.
    """
    total = F.greatest(F.coalesce(duration, F.lit(0.0)), F.lit(0.0))
    edge = F.least(total * 0.15, F.lit(600.0))
    clamp = lambda c, other: F.greatest(F.lit(0.0), F.least(total, F.coalesce(c, other)))
    zero = F.lit(0.0)
    lo = F.when(kind == "middle", total * 0.25).when(kind == "back_half", total * 0.5).when(kind == "ending", total - edge).when(kind == "custom", clamp(start, zero)).otherwise(zero)
    hi = F.when(kind == "opening", edge).when(kind == "front_half", total * 0.5).when(kind == "middle", total * 0.75).when(kind == "custom", clamp(end, total)).otherwise(total)
    if text_start is not None and text_end is not None:
        lo, hi = F.greatest(lo, F.coalesce(text_start, lo)), F.least(hi, F.coalesce(text_end, hi))
    return F.struct(
        F.bround(lo, 3).alias("start"), F.bround(F.greatest(hi, zero), 3).alias("end"), F.bround(F.greatest(hi - lo, zero), 3).alias("duration"),
        ((total > 0) & ((lo > 0.001) | (hi < total - 0.001))).alias("narrow"), (hi <= lo).alias("empty"),
    )


# --- headings ---------------------------------------------------------------------------------

# Fixed patterns: numbered headings with their level, in order of trial.
_NUMERALS = "一二三四五六七八九十百千万零〇两"
HEADINGS = (
    (f"^第[{_NUMERALS}0-9]+[章节篇部]\\s*[:：、.．-]?\\s*(\\S.{{0,59}})?$", 1),
    (f"^[{_NUMERALS}]+[、.．]\\s*\\S.{{0,59}}$", 1),
    (f"^[（(]\\s*[{_NUMERALS}]+\\s*[）)]\\s*\\S.{{0,59}}$", 2),
    ("^\\d{1,2}\\.\\d{1,2}\\.\\d{1,2}(?![%\\d])\\s+\\S.{0,59}$", 4),
    ("^\\d{1,2}\\.\\d{1,2}(?![%\\d])\\s+\\S.{0,59}$", 3),
    ("^\\d{1,2}[、．]\\s*\\S.{0,59}$", 2),
    ("^\\d{1,2}\\.(?![%\\d])\\s*\\S.{0,59}$", 2),
)
# Fixed patterns: lines of a table of contents, and figure or table titles.
TOC = (
    "(?i)^\\s*(目录|contents)\\s*$", "(?:[.…·•。．\\s]{3,}|\\t+)\\s*\\d{1,4}\\s*$", "\\.{2,}\\s*\\d{1,4}$",
    f"(?i)^\\s*(chapter\\s*\\d+|第[{_NUMERALS}0-9]+[章节篇]|[（(]?[{_NUMERALS}0-9]+[)）]|\\d+[、.．]).{{0,64}}\\d{{1,4}}$",
)
# Fixed pattern: two blanks or dots before the page number, in lines of so many characters at most.
SHORT_TOC = ("[·•\\s]{2,}\\d{1,4}$", 80)
FIGURE = "(?i)^\\s*((图表|图|表)\\s*\\d|(figure|fig\\.?|table)\\s*\\d+)"


def weak_heading_level(line: Column) -> Column:
    """Level of a line that looks like a heading, else null: the number of its hashes, or that of a numbering.

    No heading: lines of more than 100 characters, table rows, addresses, lines that end like a sentence, dates and numbers.
    """
    t = F.trim(line)
    hashes = F.regexp_extract(t, "^(#{1,6})\\s+\\S.{0,79}$", 1)
    level = F.when(hashes != "", F.length(hashes))
    for pattern, depth in HEADINGS:
        level = level.when(t.rlike(pattern), depth)
    unfit = t.rlike("[|]|://|^(http:|https:|www\\.)|[。！？；，,;]$|^[\\d\\s./年月日:-]+$") | ~F.length(t).between(1, 100)
    return F.when(~unfit, level)


def toc_entry(line: Column) -> Column:
    t = F.trim(line)
    out = (F.length(t) <= SHORT_TOC[1]) & t.rlike(SHORT_TOC[0])
    for p in TOC:
        out = out | t.rlike(p)
    return out


def figure_title(line: Column) -> Column:
    return line.rlike(FIGURE)


def normal_levels(levels: Column) -> Column:
    """Levels of one document in order: shifted and packed to 1, 2, 3 ..., each at most one deeper than the one before, 6 at most."""
    ranks = F.array_sort(F.array_distinct(levels))
    packed = F.transform(levels, lambda v: F.array_position(ranks, v).cast("int"))
    start = F.struct(F.lit(1).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        level = F.least(v, acc["last"] + 1, F.lit(6))
        return F.struct(level.alias("last"), F.concat(acc["out"], F.array(level)).alias("out"))

    return F.aggregate(packed, start, step)["out"]


# --- routing and selection --------------------------------------------------------------------


def name_score(name: str, query: str) -> float:
    """1 if the query holds the name; else the larger of the sequence ratio and .7 bigram coverage + .3 longest common block."""
    if not name or not query:
        return 0.0
    if name in query:
        return 1.0
    grams = {name[i : i + 2] for i in range(len(name) - 1)}
    asked = {query[i : i + 2] for i in range(len(query) - 1)}
    matcher = difflib.SequenceMatcher(None, name, query)
    longest = matcher.find_longest_match().size / len(name)
    return max(matcher.ratio(), 0.7 * len(grams & asked) / max(1, len(grams)) + 0.3 * longest)


def route(names: DataFrame, queries: Sequence[tuple[str, str]], doc_id: str, name: str) -> DataFrame:
    """(query_id, doc_id, score): the one document that a query names: best score of .5 at least, and .08 ahead or the next below .45.

    ``queries`` is a small stated set that travels with the tasks; names stay where they are, two candidates a task and query go on.
    """
    stated = [(q, t.lower().replace(" ", "")) for q, t in queries]
    schema = T.StructType([T.StructField("query_id", T.StringType()), names.schema[doc_id], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [(n or "").lower().replace(" ", "") for n in batch.column(1).to_pylist()]
            rows = [(q, i, round(name_score(n, t), 6)) for q, t in stated for i, n in zip(ids, texts, strict=True) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], batch.schema.field(0).type), pa.array([r[2] for r in rows], pa.float64())], schema.names)

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), doc_id)
    ranked = names.select(doc_id, name).mapInArrow(score, schema).withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    pair = ranked.groupBy("query_id").agg(F.max_by(F.struct(doc_id, "score"), -F.col("_rn")).alias("best"), F.coalesce(F.max(F.when(F.col("_rn") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    accepted = (F.col("best.score") >= 0.5) & ((F.col("best.score") - F.col("second") >= 0.08) | (F.col("second") < 0.45))
    return pair.where(accepted).select("query_id", f"best.{doc_id}", "best.score")


def evenly(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 4) -> DataFrame:
    """The rows at n evenly spaced positions of each key: round(i (size - 1) / (n - 1)), half to even."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    wanted = F.array(*(F.bround(F.lit(float(i)) * (F.col("_n") - 1) / (n - 1)).cast("int") for i in range(n)))
    return numbered.where(F.array_contains(wanted, F.col("_pos"))).drop("_pos", "_n")


def richest(rows: DataFrame, keys: Sequence[str], richness: Column, order: str) -> DataFrame:
    """One row per key, the richest (the first of equals), placed where the key was first seen."""
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(richness.alias("r"), (-F.col(order)).alias("o"))).alias("_b"), F.min(order).alias("position"))
    return g.select(*keys, "_b.*", "position")


def distinct_hits(hits: DataFrame, query: str, key: Column, order: Sequence[Column], k: int) -> DataFrame:
    """The k best hits of each query after repeats of a content key went: dedupe first, so no over-fetch is needed."""
    first = Window.partitionBy(query, "_key").orderBy(*order)
    once = hits.withColumn("_key", key).withColumn("_dup", F.row_number().over(first)).where("_dup = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)).cast("long")).where(F.col("rank") <= k).drop("_key", "_dup")


# --- trees and cues of one document, as lists --------------------------------------------------


def thin(levels: Sequence[int], tokens: Sequence[int], least: int) -> list[int | None]:
    """For each node (preorder): itself if it stays, else the node that absorbs it. A node whose subtree holds fewer than ``least`` tokens absorbs its descendants."""
    n = len(levels)
    ends, open_nodes = [n] * n, []
    sums = [0]
    for i, level in enumerate(levels):
        while open_nodes and levels[open_nodes[-1]] >= level:
            ends[open_nodes.pop()] = i
        open_nodes.append(i)
        sums.append(sums[-1] + tokens[i])
    owner: list[int | None] = [None] * n
    i = 0
    while i < n:
        owner[i] = i
        if sums[ends[i]] - sums[i] < least:
            owner[i : ends[i]] = [i] * (ends[i] - i)
            i = ends[i]
        else:
            i += 1
    return owner


def capped_parents(parents: Sequence[int | None], most: int) -> list[int | None]:
    """Parents when no node may lie deeper than ``most``: deeper ones become siblings under the ancestor one level above."""
    depth: list[int] = []
    for p in parents:
        depth.append(1 if p is None else depth[p] + 1)
    out = []
    for p in parents:
        while p is not None and depth[p] >= most:
            p = parents[p]
        out.append(p)
    return out


def untangled(starts: Sequence[float], ends: Sequence[float], least: float, gap: float = 0.0, touch: float = 0.12, stretch: float | None = None) -> list[tuple[float, float, list[int]]]:
    """Cues without flashes or overlaps: a cue shorter than ``least`` joins the one before if they touch, else the next if they
    touch, else it stays; passes are repeated until none joins. Then starts keep the gap, and a cue left empty is stretched."""
    cues = [(s, e, [i]) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
    joined = True
    while joined:
        joined, waiting, done = False, cues[::-1], []
        while waiting:
            s, e, members = waiting.pop()
            if e - s >= least:
                done.append((s, e, members))
            elif done and abs(done[-1][1] - s) <= touch:
                done[-1] = (done[-1][0], e, done[-1][2] + members)
                joined = True
            elif waiting and abs(e - waiting[-1][0]) <= touch:
                waiting[-1] = (s, waiting[-1][1], members + waiting[-1][2])
                joined = True
            else:
                done.append((s, e, members))
        cues = done
    out: list[tuple[float, float, list[int]]] = []
    for s, e, members in cues:
        if out and s < out[-1][1] + gap - 1e-9:
            s = out[-1][1] + gap
        out.append((s, e if e > s else s + (least if stretch is None else stretch), members))
    return out


def paced(texts: Sequence[str], starts: Sequence[float], ends: Sequence[float], cap: float, shortest: float = 0.0, gap: float = 0.001, last_extra: float = 3.0) -> list[tuple[float, float, list[int]]]:
    """(start, end, members) of cues where none reads faster than ``cap`` characters a second, if that can be had.

    A cue above the cap by more than .05 joins the next one if it does not end in 、 and both together take at least ``shortest``
    seconds and stay within .15 of the cap; else its end moves on, up to the gap before the next start (the last cue: by ``last_extra``).
    """
    out: list[tuple[float, float, list[int]]] = []
    i, n = 0, len(texts)
    while i < n:
        size, s, e = len(texts[i].replace("\n", "")), starts[i], ends[i]
        if size / max(e - s, 1e-6) <= cap + 0.05:
            out.append((s, e, [i]))
        elif i + 1 < n and not texts[i].rstrip().endswith("、") and ends[i + 1] - s >= shortest and (size + len(texts[i + 1].replace("\n", ""))) / max(ends[i + 1] - s, 1e-6) <= cap + 0.15:
            out.append((s, ends[i + 1], [i, i + 1]))
            i += 1
        else:
            limit = starts[i + 1] - gap if i + 1 < n else e + last_extra
            longer = min(max(e, s + max(shortest, size / cap)), limit)
            out.append((s, longer if longer > e + 0.01 else e, [i]))
        i += 1
    return out


# --- grids ------------------------------------------------------------------------------------


def table_regions(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Regions of filled cells (touching by side or corner through gaps of at most one) with their bounds: one sheet is one call."""

    def regions(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {(int(r), int(c)) for r, c, v in zip(pdf["row"], pdf["col"], pdf["value"], strict=True) if v not in (None, "")}
        out = []
        while left:
            todo, seen = [left.pop()], []
            while todo:
                r, c = todo.pop()
                seen.append((r, c))
                near = [(r + i, c + j) for i in range(-2, 3) for j in range(-2, 3) if (r + i, c + j) in left]
                left.difference_update(near)
                todo += near
            out.append((pdf[sheet].iloc[0], min(r for r, _ in seen), max(r for r, _ in seen), min(c for _, c in seen), max(c for _, c in seen), len(seen)))
        return pd.DataFrame(sorted(out), columns=[sheet, "top", "bottom", "left", "right", "cells"])

    kind = cells.schema[sheet].dataType.simpleString()
    return cells.groupBy(sheet).applyInPandas(regions, f"{sheet} {kind}, top long, bottom long, left long, right long, cells long")
