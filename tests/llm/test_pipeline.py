import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        if name == "secret_scan":
            assert out.count() == docs.count()
            assert out.where(F.col("text").rlike("token = \"[0-9a-f]{20}")).count() == 0
        elif name != "source_mixing":
            assert out.join(docs, docs.columns, "left_anti").count() == 0
        docs = out
    assert 0 < docs.count() < 2 * before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mixing", "sequence_packing"]


def test_odd_rows_and_empty_tables(spark, odd, empty):
    wide = odd.withColumnRenamed("score", "spans")
    for docs in (wide, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert bool(packed) == (docs is wide) and all(0 < r.length <= 1024 for r in packed)
    kept = corpus_pipeline.near_duplicates(spark, wide, "")
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id in (6, 8)").count() == 0


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r.sequence_id for r in rows} and all(0 < r.length <= 1024 for r in rows)


def test_near_duplicates_from_four_fifths_on(spark):
    """90 shingles with the last 10 changed have a similarity of 80 / 100, with the last 11 changed 79 / 101; 85 is for op8 alone."""
    from lattice.llm import neardup

    def copy(group, changed):
        words = [f"g{group}w{i}" for i in range(94)]
        return " ".join(words[: 94 - changed] + [f"x{w}" for w in words[94 - changed :]])

    rows = [(10 * g + k, copy(g, changed), "en", "a", 1) for g in range(20) for k, changed in enumerate((0, 10 if g % 2 else 11))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {10 * g for g in range(20)} | {10 * g + 1 for g in range(0, 20, 2)}
    assert neardup.near_duplicates(docs).where("not kept").count() == 0


def test_bands_follow_the_threshold():
    from lattice.llm import neardup

    assert neardup.banding(0.85) == (44, 8) and neardup.banding(0.8) == (76, 8)
    for threshold in (0.05, 0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.99, 1.0):
        bands, rows = neardup.banding(threshold)
        assert (1 - threshold**rows) ** bands <= 1.0001e-6


def test_a_task_of_source_mixing_has_one_worker(spark, sf_dir):
    """Each further Python step of a task is a worker of its own, which stays with the executor; a Python RDD is a daemon with workers more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = corpus_pipeline.source_mixing(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and "ExistingRDD" not in plan
