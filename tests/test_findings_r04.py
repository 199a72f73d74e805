"""Cases of the fourth review."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lattice.functions import text as tx
from lattice.operators import tables, trees, vectors
from lattice.plans import registry
from lattice.sources import pdf


def stored(folder, name, *files):
    """A table as a folder of files, each read by a task of its own."""
    (folder / f"{name}.parquet").mkdir()
    for i, columns in enumerate(files):
        pq.write_table(pa.table(columns), folder / f"{name}.parquet" / f"part-{i}.parquet")
    return f"file://{folder}"


def events(rows):
    ids, users, values = zip(*rows, strict=True)
    return {"event_id": pa.array(ids, pa.int64()), "user_id": pa.array(users, pa.int64()), "event_type": ["view"] * len(ids), "value": values}


def test_equal_users_tie_however_rows_are_split(spark, tmp_path):
    # (0.1 + 0.2) + 0.3 is more than 0.1 + (0.2 + 0.3)
    sf_dir = stored(tmp_path, "events", events([(0, 1, 0.1)]), events([(1, 1, 0.2), (2, 1, 0.3)]), events([(3, 2, 0.1), (4, 2, 0.2), (5, 2, 0.3)]))
    found = registry.queries()["cross_source_merge"](spark, sf_dir).collect()
    assert {r.user_id: r.best_rank for r in found} == {1: 1, 2: 2}


def test_chain_goes_on_below_the_first_200(spark, tmp_path):
    ids = [*range(0, 500, 2), None]
    table = events([(i, u, 1.0) for i, u in enumerate(ids[::-1])])
    sf_dir = stored(tmp_path, "events", table)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = con.execute(registry.oracle_sql()["deep_chain_pairs"]).fetchall()
    found = registry.queries()["deep_chain_pairs"](spark, sf_dir).collect()
    assert {(r.ancestor, r.node, r.distance) for r in found} == set(want) and len(found) == len(want) == 200 * 201 // 2 + 200 * 51


def test_places_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 1009,) for i in range(1009)] + [(None,)], "v long")
    assert {(r.v, r.k) for r in trees.numbered(rows.repartition(5), "v", "k").collect()} == {(i, i + 1) for i in range(1009)} | {(None, 1010)}


def test_files_are_read_once(spark, sf_dir, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = pdf.as_pdf
    monkeypatch.setattr(pdf, "as_pdf", lambda *a: made(*a).mapInArrow(counted, "path string, content binary"))
    registry.queries()["pdf_sections"](spark, sf_dir).collect()
    assert seen.value == 200


def test_sections_without_texts_are_the_same(spark):
    pages = [["cover"], ["a \U0001f600"], ["b"], ["1 Systems"]]
    contents = {
        "listed": pdf.pdf_bytes(pages, [(1, "One", 2), (2, "Sub", 3), (1, "Figure 3 x", 3), (1, "Two", 4)]),
        "figures": pdf.pdf_bytes(pages, [(1, "Figure 3 x", 3)]),
        "headed": pdf.pdf_bytes([["1 Systems", "1.1", "Parts"], ["2 Results", "1.1 Details"]]),
        "bare": pdf.pdf_bytes([["just text"], [""]]),
        "none": b"",
    }
    files = spark.createDataFrame(list(contents.items()), "path string, content binary")
    want = pdf.pdf_sections(pdf.pdf_pages(files), pdf.pdf_outline(files)).drop("text").collect()
    found = pdf.file_sections(files).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, want)) and {r.path for r in found} == {"listed", "figures", "headed", "bare"}
    assert [r.text for r in pdf.pdf_pages(files).where("path = 'listed'").orderBy("page").collect()][1] == "a \U0001f600"


def test_pairs_are_multiplied_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PAIR_BLOCK", 2)
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [-1e-9, 1.0]), (1, 3, [0.0, 0.0]), (1, 4, [3.0, 4.0, 0.0]), (1, 5, None), (1, 6, [None, 1.0]), (1, 7, []), (1, 8, [1.0, 1.0]), (1, None, [1.0, 0.0]), (2, 9, [1.0, 1.0]), (None, 10, [1.0, 1.0]), (None, 11, [1.0, 1.0])]
    pairs = vectors.pair_cosines(spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>"), "label")
    found = {(r.label, r.a, r.b): r.cosine for r in pairs.collect()}
    assert len(found) == pairs.count() == 8 * 7 and {k[0] for k in found} == {1}
    known = {(a, b): c for (_, a, b), c in found.items() if c is not None}
    assert set(known) == {(a, b) for a in (1, 2, 3, 8) for b in (1, 2, 3, 8) if a != b}
    assert known[1, 8] == known[8, 1] == known[2, 8] == 0.707107 and known[1, 3] == 0.0 and repr(known[1, 2]) == repr(known[2, 1]) == "-0.0"
    # pairs of vectors are no rows of the plan
    assert "zip_with" not in pairs._jdf.queryExecution().toString()


def test_html_is_read_as_in_the_plan(spark):
    rng = random.Random(5)
    bits = ["<tr>", "<TR class=x>", "</tr>", "<td>", "<td rowspan=2>", "<th colspan='3' ROWSPAN = \"0\">", "</td>", "</TH >", "text", "  b ", "\n", "\r\n", "\u0085", "<table>", "</table>", "<trx>", "<td", "é", ">"]
    htmls = ["".join(rng.choices(bits, k=rng.randrange(25))) for _ in range(500)] + [None]
    rows = spark.createDataFrame([(h,) for h in htmls], "h string").select("h", tables.html_rows(F.col("h")).alias("r")).collect()
    assert all([[c.asDict() for c in cells] for cells in r.r] == tables.read_rows(r.h) for r in rows)


def test_tables_are_joined_in_one_pass(spark):
    html = lambda rows: tables.as_html([[{"tag": "td", "text": t, "cols": 1, "rows": n} for t, n in r] for r in rows])
    rows = [("d", i, i, 0.0, 1.0, html([[("h", 1), ("k", 1)], [(str(i), 2), ("x", 1)] if i % 2 else [("y", 1)]]), None, 0) for i in range(1, 301)]
    rows += [("e", 1, 1, 0.0, 1.0, rows[0][5], None, 0), (None, 1, 1, 0.0, 1.0, rows[0][5], None, 0)]
    joined = tables.joined_tables(spark.createDataFrame(rows, "doc_id string, position int, page int, x0 double, x1 double, html string, caption string, footnotes int").repartition(7))
    found = {r.doc_id: r for r in joined.collect()}
    body = "".join(f'<tr><td rowspan="2">{i}</td><td>x</td></tr><tr><td>y</td></tr>' for i in range(1, 301, 2))
    assert found["d"].html == f"<table><tr><td>h</td><td>k</td></tr>{body}</table>" and found["d"].n_rows == 301 and found["d"].last_position == 300
    # a table without a document is one by itself, as a group of the SQL
    assert found["e"].html == found[None].html == rows[0][5] and len(found) == joined.count() == 3
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString().replace("joined", "")


def test_stop_words_are_looked_for_once(spark):
    texts = {"Der die the": "de", "und, the": "de", "under theory él": "und", "éles les le": "fr", "en el con de_los": "es", "theé of": "en", "": "und", "DES du der": "fr"}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").select("text", tx.stop_word_language(F.col("text")).alias("guess"))
    assert {r.text: r.guess for r in df.collect()} == {**texts, None: None}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
