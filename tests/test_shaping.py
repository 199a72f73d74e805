from pyspark.sql import functions as F

from lattice.functions import shaping


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


def test_normal_forms(spark):
    assert one(spark, shaping.nfkc(F.col("t")), "Ａ①ﬁ") == "A1fi" and one(spark, shaping.nfkc(F.col("t")), None) is None
    assert one(spark, shaping.mixed_terms(F.col("t")), "ＡＢ 数据库系统 ab") == ["ab", "数据", "据库", "库系", "系统", "数据库", "据库系", "库系统"]
    assert one(spark, shaping.question_key(F.col("t"), {"how much": "price"}), "How much is it ？！") == "priceisit"
    assert one(spark, shaping.script(F.col("t")), "a\nb\r\n\r\nc!\n\n\nd") == "ab。c!d。"
    assert one(spark, shaping.question_parts(F.col("t")), "a; b。a\n\nc？") == ["a", "b", "c"]


def test_splits():
    assert shaping.split_line("one two, three four. five six", 20, 3, 40) == ["one two, three four.", "five six"]
    assert shaping.split_line("x" * 30, 10, 2, 40) == ["x" * 30] and shaping.split_line("x" * 50, 20, 2, 40) == ["x" * 20, "x" * 30]
    assert "".join(shaping.wrapped("say (a b c) then “d e” end", 9)).replace(" ", "") == "say(abc)then“de”end"
    assert all(len(line) <= 9 for line in shaping.wrapped("say (a b c) then “d e” end", 9))
    text = "# A\naaaa\n# B\nbbbb\nbbbb"
    assert shaping.overlong(text, lambda s: s.startswith("#"), 3, 20) == ["# A\naaaa", "# B\nbbbb\nbbbb"]
    assert shaping.overlong("a" * 25, lambda s: False, 3, 10) == ["a" * 10, "a" * 10, "a" * 5]


def test_similarity(spark):
    assert one(spark, shaping.similarity(F.col("t"), F.lit("a,b c")), "abc!") == 1.0


def test_answers_and_tables(spark):
    assert one(spark, shaping.tolerant_json(F.col("t")), "Sure:\n```json\n{\"a\": [1, 2,],}\n``` done") == '{"a": [1, 2]}'
    assert one(spark, shaping.tolerant_json(F.col("t")), "no json {here") is None and one(spark, shaping.tolerant_json(F.col("t")), "x [1] y") == "[1]"
    assert one(spark, shaping.table_columns(F.col("t")), "<table><tr><td>a</td></tr><TR><th colspan='2'>b</th><td>c</td></TR></table>") == 3
    assert one(spark, shaping.table_columns(F.col("t")), "none") == 0
    rules = {"x": [("a+", 1), ("b", 3)], "y": [("a", 2)]}
    assert [one(spark, shaping.intent(F.col("t"), rules, "z"), t) for t in ("aa", "b", "c")] == ["y", "x", "z"]


def test_line_and_expansion_folds():
    from lattice.operators import folds

    assert folds.text_lines([(0, 10), (20, 30), (1, 9), (24, 34)]) == [0, 1, 0, 2]
    assert folds.expand_optional([True, False, False], [9, 1, 3], [5, 5, 5], 10, 2) == [True, False, True]
