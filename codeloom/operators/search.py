"""Exact cosine search (V1-V6). Order of the steps: metadata filter, top k, score threshold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K, MIN_SCORE = 10, 0.3


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if a vector is null or of length zero."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms)


def metadata_filter(repo_id: str | None = None, language: str | None = None, symbol_type: str | None = None) -> Column:
    """AND of the given equalities; values are bound, never pasted into text."""
    out = F.lit(True)
    for name, value in (("repo_id", repo_id), ("language", language), ("symbol_type", symbol_type)):
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    return out


def vector_search(
    rows: DataFrame, query: Sequence[float], vector: str, key: str, where: Column | None = None, k: int = TOP_K, min_score: float = MIN_SCORE
) -> DataFrame:
    """Top ``k`` rows by cosine similarity, ties by ``key``, then those that reach ``min_score``.

    Fewer than ``k`` rows may come back: the threshold follows the limit. Per-partition top k, no
    shuffle of the table. The query is a literal, so its norm is worked out once.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    norm = float(np.sqrt(np.dot(np.asarray(query, float), np.asarray(query, float))))
    candidates = rows if where is None else rows.where(where)
    length = F.sqrt(_dot(F.col(vector), F.col(vector)))
    score = F.when((length > 0) & F.lit(norm > 0), _dot(F.col(vector), literal) / (length * F.lit(norm)))
    scored = candidates.withColumn("score", score).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k).where(F.col("score") >= min_score)


def batch_top_k(rows: DataFrame, queries: DataFrame, vector: str, key: str, k: int, block: int = 2_048) -> DataFrame:
    """(query_id, key, score, rank): exact top ``k`` of all rows for every row of a stated query set.

    Queries and rows are packed into blocks of ``block`` vectors; each pair of blocks is one matrix
    product whose best ``k`` per query leave the task. Nothing is broadcast; work is spread over
    pairs of blocks. Rows with null vectors or of length zero take no part; a query does not meet
    itself.
    """
    spark = rows.sparkSession
    kind = "block long, ids binary, vectors binary, width int"

    def pack(frame: DataFrame, blocks: int) -> DataFrame:
        placed = frame.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

        def gather(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("id")
            matrix = np.stack(part["v"].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(matrix, axis=1)
            keep = norms > 0
            unit = matrix[keep] / norms[keep, None]
            return pd.DataFrame(
                {"block": part["block"].iloc[:1], "ids": [part["id"].to_numpy(np.int64)[keep].tobytes()], "vectors": [unit.tobytes()], "width": [matrix.shape[1]]}
            )

        return placed.groupBy("block").applyInPandas(gather, kind)

    row_blocks = max(1, -(-rows.count() // block))
    query_blocks = max(1, -(-queries.count() // block))
    left = pack(queries, query_blocks).select(F.col("block").alias("q"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"), "width")
    right = pack(rows, row_blocks).select(F.col("block").alias("r"), F.col("ids").alias("ri"), F.col("vectors").alias("rv"))
    met = left.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long")))).join(right, "r")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                qi, ri = np.frombuffer(b.qi, np.int64), np.frombuffer(b.ri, np.int64)
                scores = np.frombuffer(b.qv, np.float64).reshape(len(qi), b.width) @ np.frombuffer(b.rv, np.float64).reshape(len(ri), b.width).T
                scores[qi[:, None] == ri[None, :]] = -np.inf
                out = []
                for row, query in zip(scores, qi, strict=True):
                    order = np.lexsort((ri, -np.round(row, 12)))[:k]
                    out += [(query, ri[j], row[j]) for j in order if row[j] > -np.inf]
                yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    best = met.mapInPandas(multiply, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("id", key)
