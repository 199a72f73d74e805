"""Literal cases of operators whose inputs the tables don't have: ideographs, headings, folds."""

import uuid

from pyspark.sql import functions as F

from lattice.functions import text as tx
from lattice.operators import folds, intervals, nearest, trees
from lattice.sources import documents as docs


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], list(cells))
    return row.select(column.alias("v")).first().v


def test_terms_of_ideographs(spark):
    assert value(spark, tx.query_terms(F.col("t")), t="人工智能 AI_2") == sorted(["人工智能", "人工", "工智", "智能", "人工智", "工智能", "ai_2"])
    assert value(spark, tx.bigram_terms(F.col("t")), t="a 中 数据库") == ["a", "中", "数据", "据库"]


def test_scores(spark):
    score = tx.substring_score(F.col("c"), F.col("m"), F.col("q"), F.array(F.lit("red"), F.lit("fox")))
    assert value(spark, score, c="Red fox, red fox, red", m="fox", q="red fox") == 40 + 13 + 12 + 6
    assert value(spark, tx.coverage_relevance(F.col("t"), F.col("q")), t="数据 库 系统", q="数据库") == 98.0
    assert value(spark, tx.coverage_relevance(F.col("t"), F.col("q")), t="abcx", q="abcd") == 66.7


def test_parsers(spark):
    assert value(spark, tx.page_numbers(F.col("t")), t="8, 3-1,2, x,3-3") == [1, 2, 3, 8]
    assert [value(spark, tx.clock_seconds(F.col("t")), t=t) for t in ("1:02:03", "2:05", "1小时2分3秒", "1h 30min", "soon")] == [3723.0, 125.0, 3723.0, 5400.0, None]
    assert value(spark, tx.half_width(F.col("t")), t="ＡＢ１　！") == "AB1 !"
    assert value(spark, tx.sentences(F.col("t")), t="一。 Two! three") == ["一。", "Two!", "three"]
    assert value(spark, tx.uuid5_of_sha256(F.col("t")), t="x") == str(uuid.uuid5(uuid.NAMESPACE_URL, "sha256:2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"))


def test_cuts_compare_with_the_last_kept(spark):
    assert value(spark, intervals.kept_cuts(F.col("c"), 5), c=[8, 0, 4, 3]) == [0, 8]


def test_headings_and_pages(spark):
    text = "# A\n```\n# not\n```\n## B ##\n[[PAGE 3]]\n### C\nend"
    df = spark.createDataFrame([(1, text), (2, "x\ny")], "doc_id long, text string")
    assert [(r.line_no, r.level, r.title) for r in docs.markdown_headings(df).orderBy("line_no").collect()] == [(1, 1, "A"), (5, 2, "B"), (7, 3, "C")]
    assert [(r.line_no, r.page) for r in docs.marked_pages(df).where("doc_id = 1").orderBy("line_no").collect()][-2:] == [(7, 3), (8, 3)]
    assert {r.page for r in docs.marked_pages(df, lines_per_page=1).where("doc_id = 2").collect()} == {1, 2}


def test_closure_ends_on_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, parent string")
    assert {(r.ancestor, r.node) for r in trees.closure(df, "id", "parent").collect()} == {("a", "a"), ("b", "a"), ("b", "b"), ("a", "b"), ("c", "c")}


def test_files_and_subtitles(spark, tmp_path):
    (tmp_path / "B.md").write_bytes("﻿one\r\ntwo".encode())
    (tmp_path / "a.md").write_bytes(b"caf\xe9")
    (tmp_path / "c.bin").write_bytes(b"x")
    rows = docs.files(spark, str(tmp_path)).select("name", docs.decoded(F.col("content")).alias("t")).collect()
    assert sorted((r.name.lower(), r.t) for r in rows) == [("a.md", "café"), ("b.md", "one\ntwo")]
    cues = spark.createDataFrame([(1.5, 2.25, "hi"), (3661.0, 3662.0, "there")], "start double, end double, text string")
    docs.write_subtitles(cues, str(tmp_path / "srt"))
    assert sorted(map(tuple, docs.subtitles(spark, str(tmp_path / "srt")).collect())) == [(1.5, 2.25, "hi"), (3661.0, 3662.0, "there")]


def test_checked_tables(spark):
    df = spark.createDataFrame([("1", "pdf"), ("2", "exe"), (None, "md")], "doc_id string, doc_type string")
    good, bad = docs.checked(df, "documents")
    assert [r.doc_id for r in good.collect()] == ["1"] and bad.count() == 2


def test_folds():
    assert folds.token_bucket([0, 0, 0, 60], 1, 2) == [True, True, False, True]
    assert folds.throttle([0, 1, 1.5, 4, 4.1], list("aaaab"), [0, 1, 9, 9, 9], ["z"]) == [True, False, True, True, True]
    assert folds.circuit([0, 1, 2, 3, 40, 41, 75], [False] * 3 + [True, False, True, True], 3, 30) == ["closed", "closed", "closed", "open", "half_open", "open", "half_open"]
    bins = folds.lpt([5, 4, 3, 3], 10, 0.8)
    assert [sum(c for c, b in zip([5, 4, 3, 3], bins) if b == k) for k in range(2)] == [8, 7]
    assert folds.budget_merge(["a", "a", "b"], [5, 5, 9], [3, 2, 1], 14, 5) == [True, False, True]
    assert folds.merge_short([3, 3, 9, 1], 5) == [0, 0, 1, 1]
    assert folds.page_groups([10, 10, 10], 100) == [(0, 2)] and folds.page_groups([60, 60, 60], 100)[-1][1] == 2
    assert folds.edit_log(["apply", "apply", "undo", "redo", "apply"], list("xyzzz"), [0, 1, 2, 3, 0]) == [(1, "x", True), (2, "y", True), (3, "x", True), (4, "y", True), (4, "y", False)]
    assert folds.xy_cut([(50, 0, 90, 10), (0, 0, 40, 10), (0, 20, 90, 30)]) == [1, 0, 2]
    assert folds.utterances([0, 6, 7], [5.5, 6.9, 9], ["a", "a", "b"], ["x", "y.", "z"]) == [0, 0, 1]


def test_nearest_takes_any_number_of_queries(spark):
    from lattice.operators import vectors as vo

    v = spark.range(2100).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    rows = nearest.exact(v, v.select(F.col("vec_id").alias("query_id"), "embedding"), 1)
    assert rows.count() == 2100 and rows.where("score < 1").count() == 0


def test_pair_cosines_of_many_blocks(spark, monkeypatch):
    from lattice.operators import vectors as vo

    monkeypatch.setattr(vo, "PAIR_BLOCK", 16)
    v = spark.range(100).select((F.col("id") % 2).alias("label"), F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    pairs = vo.pair_cosines(v, "label")
    assert pairs.count() == pairs.select("a", "b").distinct().count() == 2 * 50 * 49
    assert pairs.where(F.abs(F.col("cosine") - F.cos(F.col("a") - F.col("b"))) > 2e-6).count() == 0
