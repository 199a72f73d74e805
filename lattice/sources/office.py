"""Office files without their programs: they are zipped XML. One file is one row of bytes, parsed in an Arrow batch."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.functions import text as tx
from lattice.operators import rules
from lattice.sources.documents import decoded

# Namespaces of the formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def docx_blocks(raw: bytes) -> list[tuple[int, str]]:
    """(heading level or 0, text) of each paragraph that has text."""
    root = _xml(zipfile.ZipFile(io.BytesIO(raw)), "word/document.xml")
    out = []
    for p in root.iter(f"{_W}p") if root is not None else ():
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
        if text:
            out.append((int(level[1]) if level else 0, text))
    return out


def pptx_slides(raw: bytes) -> list[tuple[int, str]]:
    """(number, text) of each slide, its notes behind it."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    names = sorted((int(m[1]) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))))

    def text(name: str) -> list[str]:
        root = _xml(archive, name)
        lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in root.iter(f"{_A}p")] if root is not None else []
        return [line for line in lines if line]

    return [(n, "\n".join(text(f"ppt/slides/slide{n}.xml") + text(f"ppt/notesSlides/notesSlide{n}.xml"))) for n in names]


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits), column


def xlsx_cells(raw: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of filled cells; merged ranges have the value of their first cell everywhere."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    strings = _xml(archive, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in strings.iter(f"{_S}si")] if strings is not None else []
    links = _xml(archive, "xl/_rels/workbook.xml.rels")
    targets = {r.get("Id"): r.get("Target") for r in links} if links is not None else {}
    out = []
    for sheet in _xml(archive, "xl/workbook.xml").iter(f"{_S}sheet"):
        target = targets.get(sheet.get(f"{_R}id"), "").lstrip("/")
        root = _xml(archive, target if target.startswith("xl/") else f"xl/{target}")
        cells = {}
        for c in root.iter(f"{_S}c") if root is not None else ():
            value = c.find(f"{_S}v")
            inner = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            text = inner or (value.text or "" if value is not None else "")
            if c.get("t") == "s" and value is not None:
                text = shared[int(value.text)]
            if text.strip():
                cells[_place(c.get("r"))] = text
        for m in root.iter(f"{_S}mergeCell") if root is not None else ():
            (top, left), (bottom, right) = map(_place, m.get("ref").split(":"))
            if (top, left) in cells:
                cells |= {(r, k): cells[top, left] for r in range(top, bottom + 1) for k in range(left, right + 1)}
        out += [(sheet.get("name"), r, k, v) for (r, k), v in sorted(cells.items())]
    return out


def _parsed(files: DataFrame, parse: Callable[[bytes], list[tuple]], fields: str) -> DataFrame:
    """``parse`` of the bytes in ``content`` of each row: path, ordinal and the fields; a file that is no such archive has one row with ``error``."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows, error = parse(bytes(raw)), None
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as problem:
                    rows, error = [(None,) * len(names)], str(problem)
                yield pd.DataFrame([(path, i, *r, error) for i, r in enumerate(rows)], columns=["path", "ordinal", *names, "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, ordinal long, {fields}, error string")


def docx(files: DataFrame) -> DataFrame:
    """(path, ordinal, level, text, error): paragraphs of .docx files with their heading level."""
    return _parsed(files, docx_blocks, "level int, text string")


def pptx(files: DataFrame) -> DataFrame:
    """(path, ordinal, slide, text, error): slides of .pptx files with their notes."""
    return _parsed(files, pptx_slides, "slide int, text string")


def xlsx(files: DataFrame) -> DataFrame:
    """(path, ordinal, sheet, row, col, value, error): cells of .xlsx files."""
    return _parsed(files, xlsx_cells, "sheet string, row int, col int, value string")


def region_grids(cells: DataFrame, key: str = "sheet") -> DataFrame:
    """(key, top, left, bottom, right, html): every region of cells as an HTML table; empty places are empty cells."""
    regions = rules.table_regions(cells, key)
    inside = F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    placed = regions.join(cells.select(F.col(key).alias("_k"), "row", "col", "value"), F.col(key) == F.col("_k")).where(inside)
    escaped = F.replace(F.replace(F.replace("value", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    table = placed.groupBy(key, "top", "left", "bottom", "right").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "row", "col"), escaped))).alias("_v"))
    cell = lambda r, c: F.concat(F.lit("<td>"), F.coalesce(F.try_element_at("_v", F.concat_ws(",", r, c)), F.lit("")), F.lit("</td>"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.sequence("left", "right"), lambda c: cell(r, c)), ""), F.lit("</tr>"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform(F.sequence("top", "bottom"), row), ""), F.lit("</table>"))
    return table.select(key, "top", "left", "bottom", "right", html.alias("html"))


def text_chunks(files: DataFrame, most: int = 1200) -> DataFrame:
    """(path, chunk, title, text) of plain text files: a chunk begins at a line that looks like a heading and where the next line would pass ``most`` characters."""
    lines = files.select("path", F.posexplode(F.split(decoded(F.col("content")), "\n")).alias("pos", "line")).where(F.trim("line") != "")
    order = Window.partitionBy("path").orderBy("pos")
    part = order.rowsBetween(Window.unboundedPreceding, 0)
    heading = rules.weak_heading_level(F.col("line")).isNotNull()
    sections = lines.withColumn("_h", heading).withColumn("_s", F.sum(F.col("_h").cast("int")).over(part))
    inner = Window.partitionBy("path", "_s").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cut = sections.withColumn("_c", F.floor((F.sum(F.length("line") + 1).over(inner) - 1) / most))
    chunks = cut.groupBy("path", "_s", "_c").agg(
        F.min("pos").alias("_at"), F.max_by(F.when(F.col("_h"), F.trim("line")), -F.col("pos")).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    return chunks.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("_at")) - 1).cast("long").alias("chunk"), "title", tx.newlines(F.col("text")).alias("text"))
