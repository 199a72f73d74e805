from pyspark.sql import functions as F

from lattice.operators import rules


def lines(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


def test_weak_headings(spark):
    texts = ["第一章 总则", "一、概述", "（二）方法", "1.2.3 Depth", "1.2 Wide", "3、表", "4. Four", "## Two", "plain text", "1.5% more", "第一章。", "a | b", "2024-01-02", "http://x"]
    assert lines(spark, rules.weak_heading_level(F.col("t")), *texts) == [1, 1, 2, 4, 3, 2, 2, 2, None, None, None, None, None, None]


def test_contents_and_figures(spark):
    assert lines(spark, rules.toc_entry(F.col("t")), "目录", "Intro ..... 17", "a\t\t3", "Chapter 2 Paths 40", "An ordinary line", "in 1999") == [True, True, True, True, False, False]
    assert lines(spark, rules.figure_title(F.col("t")), "图 3 结构", "Table 12", "fig. 2", "figures of speech") == [True, True, True, False]


def test_levels_and_scope(spark):
    df = spark.createDataFrame([([3, 9, 5, 3, 9],)], "v array<int>")
    assert df.select(rules.normal_levels(F.col("v")).alias("v")).first().v == [1, 2, 2, 1, 2]
    s = df.select(rules.scope(F.lit(10000.0), F.lit("ending"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(9500.0), F.lit(None).cast("double")).alias("s")).first().s
    assert (s.start, s.end, s.narrow, s.empty) == (9500.0, 10000.0, True, False)


def test_routing_needs_a_margin(spark):
    names = spark.createDataFrame([(1, "annual report 2020"), (2, "annual report 2021"), (3, None), (4, "travel rules")], "d int, n string")
    got = rules.route(names, [("a", "see the Annual Report 2020 please"), ("b", "annual report"), ("c", "travel rule")], "d", "n").collect()
    assert {(r.query_id, r.d) for r in got} == {("c", 4)}  # a: the other year is too near; b: both are


def test_trees_and_cues():
    assert rules.thin([1, 2, 3, 2, 1], [50, 60, 5, 5, 80], 70) == [0, 1, 1, 3, 4]
    assert rules.capped_parents([None, 0, 1, 2, 3], 3) == [None, 0, 1, 1, 1]
    assert rules.untangled([0, 2, 2.2, 5], [2, 2.2, 4, 6], 1.0) == [(0, 2.2, [0, 1]), (2.2, 4, [2]), (5, 6, [3])]
    assert rules.paced(["x" * 20, "y"], [0, 3], [1, 4], 10) == [(0, 4, [0, 1])]
    assert rules.paced(["x" * 20, "y" * 30], [0, 3], [1, 4], 10) == [(0, 2.0, [0]), (3, 6.0, [1])]


def test_regions(spark):
    cells = spark.createDataFrame([("s", 0, 0, "a"), ("s", 1, 1, "b"), ("s", 9, 9, "c"), ("s", 4, 4, ""), ("t", 2, 2, "d")], "sheet string, row int, col int, value string")
    assert sorted(map(tuple, rules.table_regions(cells).collect())) == [("s", 0, 1, 0, 1, 2), ("s", 9, 9, 9, 9, 1), ("t", 2, 2, 2, 2, 1)]
