import json
import random

from lattice.operators import folds, trees, vectors

FIELDS = "title string, level int"


def test_nested_and_flat_at_any_depth(spark):
    rng = random.Random(1)
    rows = [("deep", str(i), str(i - 1) if i else None, 0, f"t{i}", i + 1) for i in range(3000)]
    rows += [("wide", str(i), str(rng.randrange(i)) if i > 2 else None, rng.randrange(100), 'quote " } ] {', 1) for i in range(300)]
    rows += [("lost", "1", None, 0, "root", 1), ("lost", "2", "9", 0, "orphan", 2), ("lost", "3", "2", 0, "below the orphan", 3), ("lost", "4", "5", 0, "cycle", 1), ("lost", "5", "4", 0, "cycle", 1)]
    nodes = spark.createDataFrame(rows, f"doc_id string, node_id string, parent_node_id string, sibling_order int, {FIELDS}")
    whole = trees.nested(nodes, "doc_id", ["title", "level"])
    back = trees.flattened(whole, "doc_id", "structure", "title string").collect()
    found = {(r.doc_id, r.node_id): r for r in back}
    assert len(back) == len(found) == 3301 and {k for k in found if k[0] == "lost"} == {("lost", "1")}
    want = {(d, n): (p, t, lv) for d, n, p, _, t, lv in rows if d != "lost"}
    assert {k: (found[k].parent_node_id, found[k].title, found[k].level) for k in want} == want
    children = {}
    for d, n, p, o, *_ in rows:
        children.setdefault((d, p), []).append((o, n))
    for (d, p), c in children.items():
        if d == "wide" and p is not None:
            assert [n for _, n in sorted(c)] == [r.node_id for r in sorted((found[d, n] for _, n in c), key=lambda r: r.sibling_order)] and found[d, p].child_count == len(c)


def test_structures_of_others_are_read(spark):
    structures = [("a", json.dumps([{"title": "x", "nodes": [{"title": "y", "node_id": 7, "level": 5}, {"title": "z"}]}])), ("b", None), ("c", "no json"), ("d", '{"title": "no list"}'), ("e", "[]")]
    rows = trees.flattened(spark.createDataFrame(structures, "doc_id string, s string"), "doc_id", "s", "title string").collect()
    assert [(r.node_id, r.parent_node_id, r.sibling_order, r.level, r.child_count, r.title) for r in rows] == [("auto_1", None, 0, 1, 2, "x"), ("7", "auto_1", 0, 5, 0, "y"), ("auto_3", "auto_1", 1, 2, 0, "z")]


def test_representatives_equal_the_plain_choice(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(int(g), i, rng.normal(size=4).round(1).tolist()) for i, g in enumerate(rng.integers(0, 3, 60))] + [(9, 100, [1.0, 0.0, 0.0, 0.0])]
    found = vectors.representatives(spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>"), "label", "vec_id", "embedding", 4).collect()
    for label in (0, 1, 2, 9):
        own = [r for r in rows if r[0] == label]
        want = [own[i][1] for i in folds.mmr(np.array([r[2] for r in own]), np.ones(len(own)), 4)]
        assert [r.vec_id for r in sorted(found, key=lambda r: r.position) if r.label == label] == want
