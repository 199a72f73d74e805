"""HTML tables as cells with spans, and tables that go on over a page break joined to one."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lattice.operators import service

#: Rows at the head of a table that may repeat on the next page.
HEADER_ROWS = 5
#: Tables and characters that travel together.
_ROWS, _CHARS = 4096, 4 << 20


def html_rows(html: Column) -> Column:
    """The rows of a table as arrays of cells: tag, inner HTML, columns and rows spanned. Spans below 1 or unreadable count as 1."""

    def span(tag: Column, name: str) -> Column:
        digits = F.regexp_extract(tag, f"(?i)\\b{name}\\s*=\\s*[\"']?(\\d{{1,4}})", 1)
        return F.greatest(F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(1)), F.lit(1))

    def cell(c: Column) -> Column:
        tag = F.regexp_extract(c, "(?is)^<(t[dh]\\b[^>]*)>", 1)
        inner = F.regexp_replace(F.regexp_replace(c, "(?is)^<t[dh]\\b[^>]*>", ""), "(?is)</t[dh]\\s*>\\s*$", "")
        return F.struct(F.lower(F.substring(tag, 1, 2)).alias("tag"), F.trim(inner).alias("text"), span(tag, "colspan").alias("cols"), span(tag, "rowspan").alias("rows"))

    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<tr\\b.*?(?=<tr\\b|</tr|</table|$)"), F.lit(0))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh]\\b[^>]*>.*?(?=<t[dh]\\b|$)"), F.lit(0)), cell))


#: The patterns of ``html_rows``; letters of any script end no word. An end may stand before the last line break, so texts are taken without it.
_BREAKS, _FLAGS = ("\n", "\r", "\x85", "\u2028", "\u2029"), re.I | re.A
_TR = re.compile(r"<tr(?u:\b)[^<]*(?:<(?!tr(?u:\b)|/tr|/table)[^<]*)*", _FLAGS)
_CELL = re.compile(r"<(t[dh](?u:\b)[^>]*)>([^<]*(?:<(?!t[dh](?u:\b))[^<]*)*)", _FLAGS)
_CLOSED = re.compile(r"</t[dh]\s*>\s*(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)", _FLAGS)
_SPANS = {name: re.compile(rf"(?u:\b){name}\s*=\s*[\"']?(\d{{1,4}})", _FLAGS) for name in ("colspan", "rowspan")}


def read_rows(html: str | None) -> list[Row]:
    """The rows of ``html_rows`` as lists of dictionaries."""
    return [_known(row) if len(row) < 1024 else _cells(row) for row in _TR.findall(_unbroken(html or ""))]


def _cells(row: str) -> Row:
    return [_cell(tag, inner) for tag, inner in _CELL.findall(_unbroken(row))]


#: Headers repeat on every page. Cells are replaced, never changed, so rows may share them.
_known = lru_cache(4096)(_cells)


def _unbroken(text: str) -> str:
    if text.endswith(_BREAKS):
        return text[:-2] if text.endswith("\r\n") else text[:-1]
    return text


def _cell(tag: str, inner: str) -> dict:
    at = inner.rfind("</")
    if at >= 0 and (closed := _CLOSED.match(inner, at)):
        inner = inner[:at] + inner[closed.end() :]
    cols = rows = 1
    if len(tag) > 2:
        cols, rows = (max(1, int(m[1])) if (m := p.search(tag)) else 1 for p in _SPANS.values())
    return {"tag": tag[:2].lower(), "text": inner.strip(" "), "cols": cols, "rows": rows}


# --- grids: a row is a list of cells, a cell a dictionary of tag, text, cols, rows ---------------

Row = list[dict]
Taken = dict[int, set[int]]


def placed(rows: Sequence[Row], taken: Mapping[int, set[int]] | None = None) -> tuple[list[list[int]], list[int], Taken]:
    """(first column of each cell, columns in use of each row, columns that spans take in rows to come).

    ``taken``: columns that spans from above take in the rows, by row.
    """
    used: Taken = {r: set(c) for r, c in taken.items()} if taken else {}
    columns, widths = [], []
    for r, row in enumerate(rows):
        busy = used.get(r)
        at, own = 0, []
        for cell in row:
            while busy and at in busy:
                at += 1
            own.append(at)
            end = at + cell["cols"]
            for below in range(1, cell["rows"]):
                used.setdefault(r + below, set()).update(range(at, end))
            at = end
        columns.append(own)
        widths.append(max(at if row else 0, max(busy) + 1) if busy else at)
    return columns, widths, {r - len(rows): c for r, c in used.items() if r >= len(rows) and c}


def repeated_header(before: Sequence[Row], after: Sequence[Row]) -> int:
    """Rows at the head of the second table that repeat the first one's, with the rows that their spans reach into."""
    alike = lambda row: [(c["cols"], c["rows"], "".join(c["text"].split())) for c in row]
    n = 0
    while n < min(len(before), len(after), HEADER_ROWS) and (before[n] == after[n] or alike(before[n]) == alike(after[n])):
        n += 1
    r = 0
    while r < n:
        n = min(len(after), max([n, *(r + c["rows"] for c in after[r])]))
        r += 1
    return n


def without_placeholders(rows: Sequence[Row], taken: Mapping[int, set[int]]) -> list[Row]:
    """The rows without blank spanning cells that stand where a span from the page before goes on; what reaches further stays below it."""
    if not taken or not any(c["rows"] > 1 and not c["text"].strip() for row in rows for c in row):
        return list(rows)
    columns = placed(rows)[0]
    out = [list(row) for row in rows]
    moved: list[tuple[int, int, dict]] = []
    for r, (row, at) in enumerate(zip(rows, columns, strict=True)):
        for cell, column in zip(row, at, strict=True):
            if cell["rows"] < 2 or cell["text"].strip():
                continue
            own, over = set(range(column, column + cell["cols"])), 0
            while over < cell["rows"] and own <= set(taken.get(r + over, ())):
                over += 1
            if not over or (over < cell["rows"] and r + over >= len(rows)):
                continue
            out[r] = [c for c in out[r] if c is not cell]
            if over < cell["rows"]:
                moved.append((r + over, column, {**cell, "rows": cell["rows"] - over}))
    for r, column, cell in moved:
        left = [k for k, c in zip(columns[r], rows[r], strict=True) if any(c is x for x in out[r])]
        out[r].insert(sum(k < column for k in left), cell)
    return out


def widened(rows: Sequence[Row], widths: Sequence[int], like: Row, target: int) -> list[Row]:
    """The rows brought to ``target`` columns: those built like the row beside the break take its spans, others a wider last cell."""
    spans = [c["cols"] for c in like]
    out = []
    for row, width in zip(rows, widths, strict=True):
        if row and width < target and sum(c["cols"] for c in row) < target:
            if len(row) == len(like):
                row = [{**c, "cols": s if s > 1 else c["cols"]} for c, s in zip(row, spans, strict=True)]
            else:
                row = [*row[:-1], {**row[-1], "cols": row[-1]["cols"] + target - width}]
        out.append(row)
    return out


class Joined:
    """A table that grows by those that go on: its rows, their widths and the columns that its spans take in rows to come.

    The repeated header goes, open spans reach into the next table, the narrower one is widened.
    """

    def __init__(self, rows: Sequence[Row]):
        self.rows = list(rows)
        _, self.widths, self.taken = placed(self.rows)
        self.width = max(self.widths, default=0)

    def add(self, second: Sequence[Row], width: int) -> None:
        """``width``: the columns of the second table by itself."""
        skip = repeated_header(self.rows, second)
        rows = without_placeholders(second[skip:], self.taken)
        if self.rows and rows and self.width > width:
            # open spans from above are part of a row's width already
            inner, alone = placed(rows, self.taken)[1], placed([*second[:skip], *rows])[1][skip:]
            rows = widened(rows, [max(a, b) for a, b in zip(inner, alone, strict=True)], self.rows[-1], self.width)
        elif self.rows and rows and width > self.width:
            self.__init__(widened(self.rows, self.widths, rows[0], width))
        _, widths, taken = placed(rows, self.taken)
        if rows:
            self.rows += rows
            self.widths += widths
            self.taken = taken
            self.width = max(self.width, *widths)


def joined(first: Sequence[Row], second: Sequence[Row]) -> list[Row]:
    """One table of two."""
    table = Joined(first)
    table.add(second, max(placed(second)[1], default=0))
    return table.rows


def as_html(rows: Sequence[Row]) -> str:
    def cell(c: dict) -> str:
        spans = "".join(f' {name}="{c[key]}"' for name, key in (("rowspan", "rows"), ("colspan", "cols")) if c[key] > 1)
        return f"<{c['tag']}{spans}>{c['text']}</{c['tag']}>"

    return "<table>" + "".join("<tr>" + "".join(map(cell, row)) + "</tr>" for row in rows) + "</table>"


# --- plans ----------------------------------------------------------------------------------------


def joined_tables(tables: DataFrame) -> DataFrame:
    """(doc_id, position, last_position, n_rows, html): every table, those that go on over a page break as one.

    ``tables``: doc_id, position, page, x0, x1, html, caption, footnotes (see ``service.continued_tables`` for what goes on). The
    tables of a document come to a task one after the other, in order; it holds one with its continuations. Null and broken HTML
    has no rows. Null positions are not allowed.
    """
    order = Window.partitionBy("doc_id").orderBy("position")
    # the window deals documents to tasks and sorts them; its number tells where one begins
    placed_ = tables.select("doc_id", "position", "html", F.row_number().over(order).alias("_n"), service.fits_before().alias("_fits"))
    position = tables.schema["position"].dataType
    schema = T.StructType([tables.schema["doc_id"], T.StructField("position", position), T.StructField("last_position", position), T.StructField("n_rows", T.LongType()), T.StructField("html", T.StringType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in _chains(batches):
            held.append(row)
            size += len(row[-1])
            if len(held) == _ROWS or size >= _CHARS:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return placed_.mapInArrow(join, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The joined tables of rows (doc_id, position, html, number in the document, fits), which come in order."""
    doc, first, last, before, number = None, None, None, None, 0
    whole: Joined | None = None
    for batch in batches:
        for own, position, html, n, fits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if n > 1 and (n != number + 1 or own != doc):
                raise ValueError("tables of a document are out of order")
            rows = read_rows(html)
            table = Joined(rows)
            width = table.width
            # as wide as the one before, or rows of as many cells at the break
            if whole is not None and n > 1 and fits and (before[0] == width or (before[1] is not None and rows and before[1] == len(rows[0]))):
                whole.add(rows, width)
            else:
                if whole is not None:
                    yield doc, first, last, len(whole.rows), as_html(whole.rows)
                whole, doc, first = table, own, position
            last, number, before = position, n, (width, len(rows[-1]) if rows else None)
    if whole is not None:
        yield doc, first, last, len(whole.rows), as_html(whole.rows)
