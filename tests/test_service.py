"""Operators that SQL cannot express against plain versions, and readers on files made here."""

import io
import random
import zipfile
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lattice.operators import folds, pruned, reduction, rules, service, trees
from lattice.plans import registry
from lattice.sources import documents as docs
from lattice.sources import office


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def binaries(spark, *files):
    return spark.createDataFrame([(f"f{i}", bytearray(b)) for i, b in enumerate(files)], "path string, content binary")


def test_docx_pptx_and_broken_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    word = zipped(**{"word__document.xml": f"<w:document {w}><w:body>{p('Title', 'Heading1')}{p('')}{p('body')}{p('Part', 'heading 2')}</w:body></w:document>"})
    rows = office.docx(binaries(spark, word, b"no archive")).orderBy("path", "ordinal").collect()
    assert [(r.level, r.text) for r in rows if r.path == "f0"] == [(1, "Title"), (0, "body"), (2, "Part")]
    assert [r.error is not None for r in rows if r.path == "f1"] == [True]
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = lambda text: f"<x {a}><a:p><a:r><a:t>{text}</a:t></a:r></a:p></x>"
    deck = zipped(**{"ppt__slides__slide10.xml": slide("ten"), "ppt__slides__slide2.xml": slide("two"), "ppt__notesSlides__notesSlide2.xml": slide("note")})
    assert [(r.slide, r.text) for r in office.pptx(binaries(spark, deck)).orderBy("ordinal").collect()] == [(2, "two\nnote"), (10, "ten")]


def test_xlsx_regions_as_html(spark):
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = zipped(**{
        "xl__workbook.xml": f'<workbook {s} {r}><sheets><sheet name="one" r:id="a"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels": '<x><Relationship Id="a" Target="worksheets/s1.xml"/></x>',
        "xl__sharedStrings.xml": f"<sst {s}><si><t>head</t></si></sst>",
        "xl__worksheets__s1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>a&lt;b</t></is></c><c r="AA9"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
    })
    cells = office.xlsx(binaries(spark, book))
    assert sorted((x.row, x.col, x.value) for x in cells.collect()) == [(1, 1, "head"), (1, 2, "head"), (2, 1, "1"), (2, 2, "a<b"), (9, 27, "7")]
    grids = {x.top: x.html for x in office.region_grids(cells).collect()}
    assert grids == {1: "<table><tr><td>head</td><td>head</td></tr><tr><td>1</td><td>a&lt;b</td></tr></table>", 9: "<table><tr><td>7</td></tr></table>"}


def test_text_chunks(spark):
    text = "intro\n1.1 First part\n" + "\n".join(["x" * 99] * 30)
    rows = office.text_chunks(binaries(spark, text.encode("gb18030"))).orderBy("chunk").collect()
    assert [(r.title, len(r.text)) for r in rows][:2] == [(None, 5), ("1.1 First part", 1114)] and "".join(r.text.replace("\n", "") for r in rows) == text.replace("\n", "")


def test_encodings_and_subtitles(spark, tmp_path):
    raw = ["中文段落".encode("gb18030"), "﻿é".encode(), b"\xff\xfe\xff", None]
    got = [r.t for r in spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(raw)], "i int, b binary").orderBy("i").select(docs.decoded(F.col("b")).alias("t")).collect()]
    assert got == ["中文段落", "é", "ÿþÿ", None]
    (tmp_path / "a.srt").write_bytes(b"1\r\n00:00:01,500 --> 00:00:02,000\r\none\r\ntwo\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nthree\r\n")
    assert sorted(map(tuple, docs.subtitles(spark, str(tmp_path / "a.srt")).collect())) == [(1.5, 2.0, "one\ntwo"), (3.0, 4.0, "three")]
    cues = spark.createDataFrame([(3661.25, 3662.0, "a, b\nc"), (1.0, 2.0, "x")], "start double, end double, text string")
    docs.write_ass(cues, str(tmp_path / "ass"))
    assert sorted((r.start, r.end, r.text) for r in docs.ass_subtitles(spark, str(tmp_path / "ass")).collect()) == [(1.0, 2.0, "x"), (3661.25, 3662.0, "a, b\nc")]


def test_rejected_rows_stay_beside_the_table(spark, tmp_path):
    rows = spark.createDataFrame([("1", "pdf", 5), ("2", "exe", 6)], "doc_id string, doc_type string, other int")
    kept = docs.stored(rows, "documents", str(tmp_path / "t"))
    assert [r.doc_id for r in kept.collect()] == ["1"] and "other" not in kept.columns
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "t.rejected")).collect()] == ["2"]


def test_char_svd_against_numpy(spark):
    texts = ["the cat sat", "the cat sits", "a dog barked", "dogs bark at cats", "zz"]
    rows = reduction.char_svd(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t", 3, 1000).collect()
    found = np.array([r.embedding for r in sorted(rows)])
    grams = [[t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)] for t in texts]
    vocabulary = sorted({g for x in grams for g in x})
    m = np.array([[1 + np.log(x.count(g)) if g in x else 0.0 for g in vocabulary] for x in grams])
    m *= np.log((1 + len(texts)) / (1 + (m > 0).sum(0))) + 1
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    right = np.linalg.svd(m)[2][:3].T
    plain = m @ right
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    assert np.allclose(found @ found.T, plain @ plain.T, atol=1e-5)
    assert np.allclose(np.abs((found * plain).sum(0)), (plain * plain).sum(0), atol=1e-5)  # the same axes up to sign


def test_axes_of_passages_against_numpy(spark, sf_dir):
    """The registered query's table: singular values and leading axes up to sign, and rows of length one."""
    docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = {r.item_id: r.text for r in docs.collect()}
    counts = {i: Counter(t[k : k + n] for n in (2, 3, 4) for k in range(len(t) - n + 1)) for i, t in texts.items()}
    total = sum(counts.values(), Counter())
    vocabulary = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0].encode()))[:5000]]
    m = np.array([[1 + np.log(c[g]) if g in c else 0.0 for g in vocabulary] for c in counts.values()])
    m *= np.log((1 + len(texts)) / (1 + (m > 0).sum(0))) + 1
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    values, right = np.linalg.svd(m, full_matrices=False)[1:]
    index = pruned.build(docs, "item_id", reduction.character_grams(F.col("text")), pa.array(vocabulary))
    axes, found = reduction.right_vectors(index, np.log((1 + index.n) / (1 + index.frequency)) + 1, 16, rounds=12)
    assert np.allclose(found[:8], values[:8], rtol=1e-3)
    assert all(abs(axes[:, k] @ right[k]) > 0.999 for k in range(3))
    rows = registry.queries()["dense_passages"](spark, sf_dir).collect()
    assert sorted(r.item_id for r in rows) == sorted(texts) and all(len(r.embedding) == 16 and abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in rows)


def test_char_svd_of_nothing(spark):
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "i long, t string")
    assert [list(r.embedding) for r in reduction.char_svd(nothing, "i", "t", 3).collect()] == [[0.0]] * 3
    assert reduction.char_svd(nothing.limit(0), "i", "t", 3).count() == 0


def test_deep_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "id long, parent long")
    assert trees.closure(chain, "id", "parent").count() == 200 * 201 // 2
    nodes = spark.createDataFrame([(i,) for i in range(9)], "node long")
    needs = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (4, 3), (3, 4), (5, 4), (5, 0)], "node long, needs long")
    assert {r.node: r.level for r in trees.levels(nodes, needs).collect()} == {0: 0, 1: 1, 2: 2, 3: None, 4: None, 5: None, 6: 0, 7: 0, 8: 0}


def test_cues_against_a_plain_version():
    def plain(cues, least):
        work, changed = [(s, e, [i]) for i, (s, e) in enumerate(cues)], True
        while changed:
            changed, i = False, 0
            while i < len(work):
                s, e, m = work[i]
                if e - s >= least:
                    i += 1
                elif i and abs(work[i - 1][1] - s) <= 0.12:
                    work[i - 1 : i + 1] = [(work[i - 1][0], e, work[i - 1][2] + m)]
                    changed = True
                elif i + 1 < len(work) and abs(e - work[i + 1][0]) <= 0.12:
                    work[i : i + 2] = [(s, work[i + 1][1], m + work[i + 1][2])]
                    changed = True
                else:
                    i += 1
        return [m for *_, m in work]

    rng = random.Random(3)
    for _ in range(500):
        at, cues = 0.0, []
        for _ in range(rng.randint(1, 12)):
            at += rng.choice([0, 0, 0.1, 0.5])
            cues.append((at, at + rng.choice([0.2, 0.5, 1.1, 2.0])))
            at = cues[-1][1]
        assert [m for *_, m in rules.untangled(*zip(*cues), 1.2)] == plain(cues, 1.2)
    assert rules.untangled([0, 3], [5, 4], 1.0, 0.1) == [(0, 5, [0]), (5.1, 6.1, [1])]


def test_plans_against_a_plain_version():
    rng = random.Random(5)
    for _ in range(300):
        plans, costs, limit = zip(*[(rng.choice("abc"), rng.randint(1, 9)) for _ in range(rng.randint(1, 12))]), None, rng.randint(5, 40)
        names, costs = plans
        queues, order, used = [deque(i for i, p in enumerate(names) if p == q) for q in dict.fromkeys(names)], [], 0
        while True:
            n = len(order)
            for q in queues:
                if q and used + costs[q[0]] <= limit:
                    used += costs[q[0]]
                    order.append(q.popleft())
            if len(order) == n:
                break
        found = folds.consume_plans(names, costs, limit)
        assert [i for _, i in sorted((place, i) for i, place in enumerate(found) if place is not None)] == order


def test_scenes_and_pace():
    assert folds.merge_scenes([0, 10, 30], [10, 30, 35], [0.9, 0.5, 0.7], ["a", "b", "b"], 15) == [(0, 35, 0.5, "a / b / b")]
    assert folds.merge_scenes([0, 10, 40], [10, 40, 90], [0.9, 0.5, 0.7], ["a", None, "c"], 15) == [(0, 40, 0.5, "a"), (40, 90, 0.7, "c")]
    assert folds.merge_scenes([0], [1], [1.0], [None], 15) == [(0, 1, 1.0, None)]
    assert rules.paced(["x" * 40, "y" * 4], [0, 2], [2, 4], 11.0) == [(0, 4, [0, 1])]
    assert rules.paced(["x" * 40 + "、", "y" * 4], [0, 2], [1, 4], 11.0, gap=0.5) == [(0, 1.5, [0]), (2, 4, [1])]
    assert rules.paced(["x" * 40], [0], [1], 11.0) == [(0, 40 / 11, [0])]


def test_admission_and_caches():
    out = service.admissions([0, 1, 2, 3, 4, 11], ["a", "a", "a", "b", "b", "a"], [10, 20, 5, 5, 5, 1], 1, 3, 100)
    assert [o for o, _ in out] == ["granted"] * 4 + ["overloaded", "granted"]
    # b's first request comes before a's second: users take turns
    assert [s for _, s in out][:4] == [0, 10, 35, 30]
    assert service.admissions([0, 1], ["a", "b"], [50, 1], 1, 5, 10) == [("granted", 0), ("timeout", None)]
    assert service.cache_hits([0, 1, 2, 3, 4], list("abcab"), 2) == [False] * 5
    assert service.cache_hits([0, 1, 2, 9], list("abaa"), 2, ttl=5) == [False, False, True, False]


def test_tables_go_on(spark):
    rows = [("d", 1, 1, 0.0, 100.0, 2, [["h", "k"], ["1", "2"]], None, 0), ("d", 2, 2, 0.0, 104.0, 2, [["h ", "k"], ["3", "4"]], None, 0), ("d", 3, 3, 0.0, 104.0, 3, [["x", "y"]], "Table 2", 0), ("d", 4, 4, 0.0, 100.0, 3, [["x", "y"]], "Table 2 (continued)", 0), ("e", 1, 9, 0.0, 1.0, 1, [["x"]], None, 0)]
    df = spark.createDataFrame(rows, "doc_id string, position long, page long, x0 double, x1 double, columns int, rows array<array<string>>, caption string, footnotes int")
    assert sorted((r.doc_id, r.position, r.chain, r.skip) for r in service.continued_tables(df).collect()) == [("d", 1, 1, 0), ("d", 2, 1, 1), ("d", 3, 2, 0), ("d", 4, 2, 1), ("e", 1, 1, 0)]
