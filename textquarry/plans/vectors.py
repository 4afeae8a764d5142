"""Queries over vectors: nearest neighbours, fusion, reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import vector_search as V
from textquarry.plans.registry import query, table


def points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each label as a query: query_id, query_vector (rounded, so that summing order doesn't tell)."""
    parts = points(spark, folder).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    return parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(F.col("label").alias("query_id"), F.transform("v", lambda p: p["x"]).alias("query_vector"))


CENTROIDS = """p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p),
m AS (SELECT label, i, round(avg(x), 9) AS x FROM e GROUP BY ALL),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS w FROM m GROUP BY label)"""


def knn_sql(score: str, order: str, k: int, where: str = "TRUE") -> str:
    return f"WITH {CENTROIDS}, s AS (SELECT query_id, vec_id, label, {score} AS score FROM p, q WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {order}, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= {k})"


COSINE, DOT, EUCLID = "list_cosine_similarity(v, w)", "list_dot_product(v, w)", "list_distance(v, w)"
SHOWN = " SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r"


def _knn(spark: SparkSession, folder: str, metric: str, k: int = 10, **options) -> DataFrame:
    return V.knn(points(spark, folder), centroids(spark, folder), k, metric=metric, **options)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(knn_sql(COSINE, "DESC", 10) + SHOWN)
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_knn(spark, folder, "cosine"))


@query(knn_sql(DOT, "DESC", 10) + SHOWN)
def knn_dot(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_knn(spark, folder, "dot"))


@query(knn_sql(EUCLID, "ASC", 10) + SHOWN)
def knn_euclid(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_knn(spark, folder, "euclid"))


@query(knn_sql(COSINE, "DESC", 10, "label <> query_id") + SHOWN)
def knn_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest points of other labels."""
    return _shown(_knn(spark, folder, "cosine", apart="label"))


LISTS = knn_sql(COSINE, "DESC", 30).replace(", r AS", ", a AS").replace("WITH ", "") + ", " + "sb AS (SELECT query_id, vec_id, label, " + EUCLID + " AS score FROM p, q), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), vec_id)::INTEGER AS rank FROM sb QUALIFY rank <= 30)"
FUSED = f"""WITH {LISTS}, u AS (SELECT query_id, vec_id, 0.7 / (60 + rank) + CASE WHEN rank = 1 THEN 0.05 WHEN rank <= 3 THEN 0.02 ELSE 0 END AS s FROM a
UNION ALL SELECT query_id, vec_id, 0.3 / (60 + rank) + CASE WHEN rank = 1 THEN 0.05 WHEN rank <= 3 THEN 0.02 ELSE 0 END FROM b),
f AS (SELECT query_id, vec_id, round(sum(s), 9) AS score FROM u GROUP BY ALL)"""


def _lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return tuple(_knn(spark, folder, m, 30).select("query_id", "vec_id", "rank") for m in ("cosine", "euclid"))


@query(FUSED + " SELECT * FROM f")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _lists(spark, folder)
    both = a.withColumn("list", F.lit(0)).unionByName(b.withColumn("list", F.lit(1)))
    return V.rrf(both, {0: 0.7, 1: 0.3}, key="vec_id").select("query_id", "vec_id", F.round("score", 9).alias("score"))


HYBRID = FUSED + ", h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM f)"


@query(HYBRID + " SELECT query_id, vec_id, score, rank FROM h WHERE rank <= 10")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _lists(spark, folder)
    both = a.withColumn("list", F.lit(0)).unionByName(b.withColumn("list", F.lit(1)))
    fused = V.rrf(both, {0: 0.7, 1: 0.3}, key="vec_id").withColumn("score", F.round("score", 9))
    return V.ranked(fused, key="vec_id").where("rank <= 10").select("query_id", "vec_id", "score", "rank")


@query(HYBRID + """, g AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, label ORDER BY rank, vec_id) > 1 AS again FROM h JOIN embeddings USING (vec_id))
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY again, rank, vec_id)::INTEGER AS place FROM g QUALIFY place <= 10""")
def diversify_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid results, the first of each label first."""
    a, b = _lists(spark, folder)
    both = a.withColumn("list", F.lit(0)).unionByName(b.withColumn("list", F.lit(1)))
    fused = V.ranked(V.rrf(both, {0: 0.7, 1: 0.3}, key="vec_id").withColumn("score", F.round("score", 9)), key="vec_id")
    named = fused.join(points(spark, folder).select("vec_id", "label"), "vec_id")
    return V.diversify(named, 10, group="label", key="vec_id").select("query_id", "vec_id", "place")


@query(knn_sql(COSINE, "DESC", 30) + """, d AS (SELECT r.query_id, r.vec_id, round(r.score, 9) AS score, r.rank, list_dot_product(p.v, q.w) AS rr FROM r JOIN p ON r.vec_id = p.vec_id JOIN q ON r.query_id = q.query_id),
t AS (SELECT *, CASE WHEN max(rr) OVER (PARTITION BY query_id) > 0 THEN max(rr) OVER (PARTITION BY query_id) ELSE 1 END AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM d),
w AS (SELECT *, CASE WHEN place <= 3 THEN 0.75 WHEN place <= 10 THEN 0.6 ELSE 0.4 END AS k FROM t)
SELECT query_id, vec_id, round(score * k + rr / top * (1 - k), 6) AS blended FROM w""")
def rerank_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine results blended with their dot products as a reranker's scores."""
    q = centroids(spark, folder)
    found = _knn(spark, folder, "cosine", 30).withColumn("score", F.round("score", 9)).join(points(spark, folder).select("vec_id", "embedding"), "vec_id").join(q, "query_id")
    rated = found.withColumn("rerank_score", V.dot("embedding", "query_vector"))
    return V.rerank_blend(rated, key="vec_id").select("query_id", "vec_id", F.round("blended", 6).alias("blended"))


@query(f"""WITH {CENTROIDS}, pairs AS (SELECT a.query_id, b.label, a.vec, b.vec_id, list_dot_product(a.v, b.v) AS d FROM (SELECT label AS query_id, vec_id AS vec, v FROM p WHERE vec_id % 50 = 0) a JOIN p b ON TRUE),
best AS (SELECT query_id, vec, label, max(d) AS d FROM pairs GROUP BY ALL) SELECT query_id, label, round(sum(d), 5) AS score FROM best GROUP BY ALL""")
def maxsim_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Late interaction of the query vectors of each label (every row whose id is divisible by 50) with all labels."""
    p = points(spark, folder)
    q = p.where("vec_id % 50 = 0").select(F.col("label").alias("query_id"), "vec_id", F.col("embedding").alias("query_vector"))
    return V.maxsim_of_sets(p, q).withColumn("score", F.round("score", 5))
