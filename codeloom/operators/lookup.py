"""Symbol look-up: exact names, else prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tagged(kinds: list[tuple[str, DataFrame]]) -> DataFrame:
    """Tables of several kinds of symbols as one, tagged by kind and its order (O3)."""
    parts = [d.withColumns({"symbol_type": F.lit(kind), "kind_order": F.lit(k)}) for k, (kind, d) in enumerate(kinds)]
    return reduce(DataFrame.unionByName, parts)


def exact(symbols: DataFrame, name: str) -> DataFrame:
    """Rows of that name; the filter reaches the scan."""
    return symbols.where(F.col("name") == F.lit(name))


def by_prefix(symbols: DataFrame, name: str) -> DataFrame:
    """Rows whose name starts so, case-sensitive; ``''`` gives every named row."""
    return symbols.where(F.col("name").startswith(name))


def exact_else_prefix(symbols: DataFrame, name: str) -> DataFrame:
    """Exact hits if there is any over all repositories, else prefix hits.

    One scan: exact hits are prefix hits of rank 0, and the lowest rank that occurs is kept.
    """
    ranked = by_prefix(symbols, name).withColumn("_cl_rank", F.when(F.col("name") == F.lit(name), 0).otherwise(1))
    # All that the aggregation sends is one number per partition.
    lowest = ranked.agg(F.min("_cl_rank").alias("_cl_lowest"))
    return ranked.join(F.broadcast(lowest), ranked["_cl_rank"] == lowest["_cl_lowest"]).drop("_cl_rank", "_cl_lowest")


def in_repositories(symbols: DataFrame, repos: DataFrame, repo_id: str | None = None) -> DataFrame:
    """Symbols of configured repositories; an unknown ``repo_id`` gives nothing (L1)."""
    wanted = repos.select(F.col("id").alias("repo_id")).where("repo_id IS NOT NULL").distinct()
    if repo_id is not None:
        wanted = wanted.where(F.col("repo_id") == F.lit(repo_id))
    return symbols.join(wanted, "repo_id", "left_semi")


def expand(hits: DataFrame, texts: DataFrame, edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Hits with their source text and, for functions, callers and callees.

    ``texts``: repo_id, file_path, name, source_text, one row per key. ``edges``: repo_id,
    caller_name, caller_file, callee_name, callee_file. ``functions``: repo_id, name, file_path,
    start_line, end_line.
    """
    keyed = hits.withColumn("_cl_hit", F.monotonically_increasing_id())
    known = functions.select("repo_id", F.col("name").alias("n_name"), F.col("file_path").alias("n_file"), F.col("start_line").alias("n_start"), F.col("end_line").alias("n_end")).distinct()
    target = keyed.where("symbol_type = 'function'").select("_cl_hit", "repo_id", "name", "file_path")

    def side(own: str, other: str, out: str) -> DataFrame:
        own_name, own_file = f"{own}_name", f"{own}_file"
        met = target.join(edges, (target["repo_id"] == edges["repo_id"]) & (target["name"] == edges[own_name]) & (target["file_path"] == edges[own_file])).select(
            "_cl_hit", target["repo_id"], F.col(f"{other}_name").alias("n_name"), F.col(f"{other}_file").alias("n_file")
        )
        entry = F.struct(F.col("n_name").alias("name"), F.col("n_file").alias("file_path"), F.col("n_start").alias("start_line"), F.col("n_end").alias("end_line"))
        return met.join(known, ["repo_id", "n_name", "n_file"]).groupBy("_cl_hit").agg(F.sort_array(F.collect_set(entry)).alias(out))

    none = F.array().cast("array<struct<name:string,file_path:string,start_line:int,end_line:int>>")
    return (
        keyed.join(texts, ["repo_id", "file_path", "name"], "left")
        .join(side("callee", "caller", "callers"), "_cl_hit", "left")
        .join(side("caller", "callee", "callees"), "_cl_hit", "left")
        .withColumns({"source_text": F.coalesce("source_text", F.lit("")), "callers": F.coalesce("callers", none), "callees": F.coalesce("callees", none)})
        .drop("_cl_hit")
    )


def ordered(hits: DataFrame, repos: DataFrame) -> DataFrame:
    """Order of results: registry, kind, emission."""
    place = Window.orderBy("added_at", "id")
    numbers = repos.select("id", "added_at").distinct().select(F.col("id").alias("repo_id"), F.row_number().over(place).alias("_cl_repo"))
    return hits.join(numbers, "repo_id").orderBy("_cl_repo", "kind_order", "ordinal").drop("_cl_repo")
