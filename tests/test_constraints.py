from pyspark.sql import functions as F

from lattice.sources import constraints
from lattice.sources.constraints import Rules


def broken(rows, *columns):
    return [(*(r[c] for c in columns), ",".join(r.broken)) for r in rows.collect()]


def test_each_rule_and_the_first_of_a_key(spark):
    rows = spark.createDataFrame([(1, "a", "x", 5), (1, "b", "x", 3), (1, "c", "bad", 1), (None, "d", "x", 0), (2, None, "x", 0), (2, "e", None, 0), (3, "long name", "y", 0)], "id int, name string, kind string, at int")
    rules = Rules(("id", "name"), {"kind": ("x", "y")}, {"short": "length(name) < 5"}, {}, [("id",)], {"kind": "'x'"})
    found = broken(constraints.judged(rows, rules, order=[F.col("at")]), "name")
    assert sorted(found, key=repr) == sorted([("a", "unique:id"), ("b", ""), ("c", "domain:kind"), ("d", "required:id"), (None, "required:name"), ("e", ""), ("long name", "check:short")], key=repr)
    assert {r.name: r.kind for r in constraints.kept(constraints.judged(rows, rules, order=[F.col("at")])).collect()} == {"b": "x", "e": "x"}


def test_references_and_equal_rows(spark):
    docs = spark.createDataFrame([("1",), ("2",)], "doc_id string")
    rows = spark.createDataFrame([("1", "u", "k")] * 50 + [("9", "u", "k"), (None, "u", "k")], "doc_id string, user_id string, kb_id string").withColumn("is_temporary", F.lit(None).cast("boolean"))
    judged = constraints.judged(rows.repartition(5), constraints.TABLES["document_bindings"], {"documents": docs})
    counts = {r["b"]: r["count"] for r in judged.groupBy(F.array_join("broken", ",").alias("b")).count().collect()}
    assert counts == {"": 1, "unique:doc_id,user_id,kb_id": 49, "reference:doc_id": 1, "required:doc_id": 1}
    assert constraints.judged(rows.limit(0), constraints.TABLES["document_bindings"], {"documents": docs}).count() == 0


def test_vectors_of_another_dimension(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (1, [0.0, 0.0])], "vec_id int, embedding array<double>")
    found = constraints.judged(rows, constraints.collection(2))
    assert sorted(",".join(r.broken) for r in found.collect()) == ["", "check:dimension", "required:embedding", "unique:vec_id"]
