"""Queries over the change feed (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import incremental
from codeloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = incremental.pending_changes(table(spark, sf_dir, "file_changes"), table(spark, sf_dir, "checkpoints"))
    return todo.select("change_id").distinct()


def p3_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending changes, their span of sequence numbers and the late ones, per repository."""
    todo = incremental.pending_changes(table(spark, sf_dir, "file_changes"), table(spark, sf_dir, "checkpoints"))
    late = F.coalesce(F.col("ingested_at") <= F.col("updated_at"), F.lit(False))
    return todo.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("pending"),
        F.min("seq").cast("long").alias("first_seq"),
        F.max("seq").cast("long").alias("last_seq"),
        F.count_if(~late).alias("not_yet_seen"),
    )


_PENDING = r"""
WITH keyed AS (
  SELECT repo_id, commit_sha, status, path, old_path, seq, change_id, ingested_at,
         row_number() OVER (PARTITION BY repo_id, commit_sha, status, path, old_path ORDER BY ingested_at, change_id) AS rn
  FROM file_changes WHERE repo_id IS NOT NULL),
feed AS (
  SELECT * FROM keyed WHERE rn = 1 AND left(status, 1) IN ('A', 'M', 'D', 'R')
    AND (coalesce(regexp_matches(path, '(?i)\.(ts|tsx|js|mjs|py|rs|go|cpp|cc|h|hpp)$'), false)
      OR coalesce(regexp_matches(old_path, '(?i)\.(ts|tsx|js|mjs|py|rs|go|cpp|cc|h|hpp)$'), false))),
cp AS (
  SELECT repo_id, updated_at, last_commit, processed_files FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY updated_at DESC, last_commit DESC) AS rn
    FROM checkpoints WHERE repo_id IS NOT NULL AND updated_at IS NOT NULL) WHERE rn = 1),
last AS (
  SELECT cp.repo_id, max(c.seq) AS last_seq FROM cp JOIN file_changes c
    ON c.repo_id = cp.repo_id AND cp.last_commit <> '' AND starts_with(lower(c.commit_sha), lower(cp.last_commit))
  GROUP BY cp.repo_id),
pending AS (
  SELECT f.*, cp.updated_at FROM feed f LEFT JOIN cp ON cp.repo_id = f.repo_id LEFT JOIN last ON last.repo_id = f.repo_id
  WHERE NOT coalesce(f.ingested_at <= cp.updated_at
    AND (coalesce(f.seq <= last.last_seq, false) OR coalesce(list_contains(cp.processed_files, f.path), false)), false))
"""

QUERIES = {"p3_found": p3_found, "p3_backlog": p3_backlog}
SQL = {
    "p3_found": _PENDING + "SELECT DISTINCT change_id FROM pending",
    "p3_backlog": _PENDING
    + """SELECT repo_id, count(*)::BIGINT AS pending, min(seq)::BIGINT AS first_seq, max(seq)::BIGINT AS last_seq,
      count(*) FILTER (WHERE NOT coalesce(ingested_at <= updated_at, false))::BIGINT AS not_yet_seen
    FROM pending GROUP BY repo_id""",
}
