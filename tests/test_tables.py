import random

import pytest
from pyspark.sql import functions as F

from lattice.operators import tables


def cell(text, cols=1, rows=1):
    return {"tag": "td", "text": text, "cols": cols, "rows": rows}


def grid(rng, n_rows, n_cols):
    """A table in which every place belongs to one cell, with random spans."""
    owner, out = {}, []
    for r in range(n_rows):
        row = []
        for c in range(n_cols):
            if (r, c) in owner:
                continue
            cols = 1
            while c + cols < n_cols and (r, c + cols) not in owner and rng.random() < 0.25:
                cols += 1
            rows = min(n_rows - r, rng.choice([1, 1, 1, 2, 3]))
            owner |= {(r + i, c + j): 1 for i in range(rows) for j in range(cols)}
            row.append(cell(f"{r}.{c}", cols, rows))
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(80))
def test_a_table_cut_at_a_page_break_is_whole_again(seed):
    """Spans over the break are written in the first part only; a header may repeat."""
    rng = random.Random(seed)
    whole = grid(rng, rng.randrange(2, 9), rng.randrange(1, 6))
    at = rng.randrange(1, len(whole))
    places, widths, _ = tables.placed(whole)
    assert set(widths) == {max(widths)}
    first, second = whole[:at], whole[at:]
    taken = tables.placed(first)[2]
    assert tables.placed(second, taken)[0] == places[at:]
    if max(tables.placed(second)[1], default=0) == max(widths) or not taken:
        assert tables.joined(first, second) == whole
    head = [[cell("h", max(widths))]]
    assert tables.joined(head + first, head + second)[: 1 + at] == head + first


def test_spans_of_a_header_and_placeholders():
    head = [[cell("a", rows=2), cell("b", 2)], [cell("c"), cell("d")]]
    first = [*head, [cell("x", rows=3), cell("1"), cell("2")]]
    second = [*head, [cell("", rows=2), cell("3"), cell("4")], [cell("5"), cell("6")], [cell("7"), cell("8"), cell("9")]]
    whole = tables.joined(first, second)
    assert [[c["text"] for c in r] for r in whole] == [["a", "b"], ["c", "d"], ["x", "1", "2"], ["3", "4"], ["5", "6"], ["7", "8", "9"]]
    assert tables.repeated_header(first, second) == 2
    # a placeholder that reaches further than the span above stays for the rest
    longer = [[cell("", rows=3), cell("3")], [cell("5")], [cell("7")]]
    assert [[(c["text"], c["rows"]) for c in r] for r in tables.without_placeholders(longer, {0: {0}})] == [[("3", 1)], [("", 2), ("5", 1)], [("7", 1)]]


def test_the_narrower_table_is_widened():
    wide, narrow = [[cell("a", 2), cell("b")]], [[cell("c"), cell("d")], [cell("e")]]
    assert [[c["cols"] for c in r] for r in tables.joined(wide, narrow)] == [[2, 1], [2, 1], [3]]
    assert [[c["cols"] for c in r] for r in tables.joined(narrow, wide)] == [[2, 1], [3], [2, 1]]


def test_html_is_read(spark):
    html = "<TABLE><thead><tr class=x><th colspan='2'>A <b>b</b></th></tr></thead><tr><td rowspan=2>1<td>2</td></tr>\n<tr><td></td></tr></table>"
    rows = spark.createDataFrame([(html,), (None,), ("<p>none</p>",)], "h string").select(tables.html_rows(F.col("h")).alias("r")).collect()
    assert [[tuple(c) for c in r] for r in rows[0].r] == [[("th", "A <b>b</b>", 2, 1)], [("td", "1", 1, 2), ("td", "2", 1, 1)], [("td", "", 1, 1)]]
    assert rows[1].r == [] and rows[2].r == []


def test_tables_of_documents_are_joined(spark):
    html = lambda rows: tables.as_html([[cell(*c) if isinstance(c, tuple) else cell(c) for c in r] for r in rows])
    rows = [
        ("d", 1, 1, 0.0, 100.0, html([["h", "k"], [("1", 1, 2), "2"]]), None, 0), ("d", 2, 2, 0.0, 104.0, html([["h ", "k"], ["3"], ["5", "6"]]), None, 0),
        ("d", 3, 3, 0.0, 104.0, html([["x", "y", "z"]]), "Table 2", 0), ("d", 4, 4, 0.0, 100.0, html([["x", "y", "z"], ["u", "v", "w"]]), "Table 2 (continued)", 0),
        ("e", 1, 9, 0.0, 1.0, None, None, 0),
    ]
    df = spark.createDataFrame(rows, "doc_id string, position int, page int, x0 double, x1 double, html string, caption string, footnotes int")
    found = {(r.doc_id, r.position): r for r in tables.joined_tables(df).collect()}
    assert found["d", 1].html == html([["h", "k"], [("1", 1, 2), "2"], ["3"], ["5", "6"]]) and found["d", 1].last_position == 2
    assert found["d", 3].html == html([["x", "y", "z"], ["u", "v", "w"]]) and found["e", 1].html == "<table></table>"
    assert len(found) == 3 and tables.joined_tables(df.limit(0)).count() == 0
