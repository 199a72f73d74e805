import json

from lattice.operators import direct


def test_pages_that_are_there_and_missing(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "doc_id string, page int, content string")
    asked = spark.createDataFrame([("a", [2, 1, 2, 0, -4, 9]), ("c", [1]), ("b", None)], "doc_id string, pages array<int>")
    rows = sorted(tuple(r) for r in direct.pages(asked, stored).collect() if r.content or True)
    assert sorted(map(repr, rows)) == sorted(map(repr, [("a", 1, "x", True), ("a", 2, None, True), ("a", 9, None, False), ("c", 1, None, False)]))


def test_metadata_by_group(spark):
    profiles = spark.createDataFrame([("a", "A", 3), ("b", "B", None)], "doc_id string, doc_name string, page_count int")
    asked = spark.createDataFrame([("g", ["b", "a", "a", "zz"]), ("h", ["yy"])], "group_ref string, doc_ids array<string>")
    rows = {r.group_ref: r for r in direct.metadata(asked, profiles, ["doc_name", "page_count"]).collect()}
    assert json.loads(rows["g"].entries) == [{"doc_name": "A", "page_count": 3}, {"doc_name": "B"}] and rows["g"].missing == ["zz"]
    assert json.loads(rows["h"].entries) == [] and rows["h"].missing == ["yy"]


def test_an_image_and_a_section_are_used_once():
    images, sections, topics = ["1", "1", "2", "3", "4", "5"], ["s", "t", " s ", "t", "u", "v"], ["a", "b", "c", "d", " ", "e"]
    assert direct.accepted_insertions(images, sections, topics, [True] * 5 + [False]) == [True, False, False, True, False, False]
