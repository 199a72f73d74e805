"""Vector operators over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.catalog import table
from lattice.operators import nearest
from lattice.operators import vectors as vo
from lattice.plans.registry import query

_KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q WHERE {where})
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query("knn_top10_cosine", _KNN.format(where="true"))
@query("knn_top10_every_100th", _KNN.format(where="true"))
def knn_top10_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return nearest.exact(v, _queries(v), 10)


@query("filtered_knn", _KNN.format(where="label IN (1, 3, 5)"))
@query("filtered_knn_every_100th", _KNN.format(where="label IN (1, 3, 5)"))
def filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return nearest.exact(v.where(F.col("label").isin(1, 3, 5)), _queries(v), 10)


@query("ivf_knn_top10")
def ivf_knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through trained lists: recall of 0.95 is aimed at, see ``nearest.build``."""
    v = table(spark, sf_dir, "embeddings")
    return nearest.probe(nearest.build(v), _queries(v), 10).select("query_id", "vec_id", "score", "rank")


_UNIT = """
WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS l FROM embeddings),
u AS (SELECT vec_id, label, unnest(list_transform(embedding::DOUBLE[], lambda x: x / l)) AS x, generate_subscripts(embedding, 1) AS pos FROM n),
s AS (SELECT label, pos, sum(x) AS s, count(*) AS n FROM u GROUP BY 1, 2)"""


@query("genericness", _UNIT + " SELECT u.label, vec_id, round((sum(x * s) - 1) / any_value(n), 6) AS genericness FROM u JOIN s ON u.label = s.label AND u.pos = s.pos GROUP BY 1, 2")
def genericness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.genericness(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")


@query("label_diversity", _UNIT + ", g AS (SELECT label, sum(s * s) AS q, any_value(n) AS n FROM s GROUP BY 1) SELECT label, round(CASE WHEN n > 1 THEN 1 - (q - n) / (n * (n - 1)) ELSE 0 END, 6) AS diversity FROM g")
def label_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.diversity(table(spark, sf_dir, "embeddings"), ["label"], "embedding")


@query("label_centroid_pooling", """
WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY 1, 2),
l AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY 1)
SELECT m.label, m.pos, round(m / l, 6) AS x FROM m JOIN l ON m.label = l.label""")
def label_centroid_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = vo.mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("softmax_pooling", """
WITH e AS (SELECT label, exp((vec_id % 7) / 7 - 1) AS w, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, sum(w * x) / sum(w) AS m FROM e GROUP BY 1, 2),
l AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY 1)
SELECT m.label, m.pos, round(m / l, 6) AS x FROM m JOIN l ON m.label = l.label""")
def softmax_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    pooled = vo.mean_pool(v, ["label"], "embedding", vo.softmax_weight(F.col("vec_id") % 7 / 7, F.lit(1.0)))
    return pooled.select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("motion_by_order", """
WITH p AS (SELECT label, embedding::DOUBLE[] AS a, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, round(coalesce(avg(1 - list_cosine_similarity(a, b)), 0), 6) AS motion FROM p GROUP BY 1""")
def motion_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.motion(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], "embedding")


@query("vector_counts", "SELECT label, count(*) AS n, min(len(embedding))::BIGINT AS dim FROM embeddings GROUP BY label")
def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).cast("long").alias("dim"))


@query("temporal_coverage", """
SELECT user_id, round(least(1, greatest(0, (epoch(max(ts)) - epoch(min(ts))) / (31 * 86400))), 6) AS coverage FROM events GROUP BY user_id""")
def temporal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.max(t) - F.min(t)) / (31 * 86400))), 6).alias("coverage"))
