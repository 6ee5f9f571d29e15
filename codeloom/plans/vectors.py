"""Queries of vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import search
from codeloom.session import table


def _query(rows: DataFrame) -> list[float]:
    """The vector of row 0 is the query text's embedding."""
    first = rows.where("vec_id = 0").select("embedding").first()
    return list(first[0]) if first else [0.0]


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return _shown(search.vector_search(rows, _query(rows), "embedding", "vec_id"))


def vector_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata filter comes before the top k."""
    rows = table(spark, sf_dir, "embeddings")
    return _shown(search.vector_search(rows, _query(rows), "embedding", "vec_id", F.col("label") == 3, min_score=-1.0))


def vector_threshold_after_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A high threshold leaves fewer than k rows."""
    rows = table(spark, sf_dir, "embeddings")
    return _shown(search.vector_search(rows, _query(rows), "embedding", "vec_id", k=20, min_score=0.5))


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 as a query, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    found = search.batch_top_k(rows, rows.where("vec_id % 20 = 0"), "embedding", "vec_id", 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


_SCORED = """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
scored AS (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS s FROM embeddings e, q)
"""
QUERIES = {f.__name__: f for f in (vector_search, vector_search_filtered, vector_threshold_after_topk, knn_batch)}
SQL = {
    "vector_search": _SCORED + "SELECT vec_id, label, round(s, 6) AS score FROM (SELECT * FROM scored ORDER BY s DESC, vec_id LIMIT 10) WHERE s >= 0.3",
    "vector_search_filtered": _SCORED + "SELECT vec_id, label, round(s, 6) AS score FROM (SELECT * FROM scored WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 10) WHERE s >= -1",
    "vector_threshold_after_topk": _SCORED + "SELECT vec_id, label, round(s, 6) AS score FROM (SELECT * FROM scored ORDER BY s DESC, vec_id LIMIT 20) WHERE s >= 0.5",
    "knn_batch": """
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id)::INTEGER AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 10""",
}
