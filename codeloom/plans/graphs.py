"""Queries of the symbol graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import changes, graph
from codeloom.parsing.extract import parse_files
from codeloom.session import table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as callers, parts as callees, the supplier as the callee's file."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.lit("r").alias("repo_id"),
        F.col("l_orderkey").cast("string").alias("caller_name"),
        F.lit("orders").alias("caller_file"),
        F.col("l_partkey").cast("string").alias("callee_name"),
        F.lit("parts").alias("callee_file"),
    ).distinct()


def call_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and callees of all orders and parts."""
    orders = table(spark, sf_dir, "orders").select(F.lit("r").alias("repo_id"), F.col("o_orderkey").cast("string").alias("name"), F.lit("orders").alias("file_path"))
    parts = table(spark, sf_dir, "part").select(F.lit("r").alias("repo_id"), F.col("p_partkey").cast("string").alias("name"), F.lit("parts").alias("file_path"))
    found = graph.neighbors(_edges(spark, sf_dir), orders.unionByName(parts))
    return found.select("name", "file_path", "relation", "neighbor")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.lit("r").alias("repo_id"), F.col("l_suppkey").cast("string").alias("file_path"), F.col("l_partkey").cast("string").alias("callee_name"), "l_orderkey", "l_linenumber")


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of brand b is a function of each supplier whose key is b's number; names repeat."""
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.lit("r").alias("repo_id"),
        F.regexp_extract("p_brand", r"(\d+)", 1).alias("file_path"),
        F.col("p_partkey").cast("string").alias("name"),
        F.lit("").alias("class_name"),
        F.col("p_size").alias("ordinal"),
    )


def callsite_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names called per file: the same file's function, else every one of the repository."""
    found = graph.resolve_calls(_sites(spark, sf_dir), _functions(spark, sf_dir))
    return found.select("file_path", "callee_name", "callee_file")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from the first function of each calling file."""
    edges = graph.call_edges(_sites(spark, sf_dir), _functions(spark, sf_dir))
    return edges.select("caller_name", "caller_file", "callee_name", "callee_file", "cross_file")


def first_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("r").alias("repo_id"),
        F.col("l_orderkey").cast("string").alias("file_path"),
        F.col("l_partkey").cast("string").alias("name"),
        F.lit("").alias("class_name"),
        F.col("l_linenumber").alias("ordinal"),
    )
    return graph.first_function(lines).select("file_path", "name")


def has_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of classes of the same file, from parsed names of the chunk table."""
    rows = table(spark, sf_dir, "chunks").select("repo_id", "file_path", F.lower(F.trim("symbol_type")).alias("kind"), "symbol_name").where("symbol_name IS NOT NULL")
    dot = F.instr("symbol_name", ".")
    functions = rows.where("kind = 'function'").select(
        "repo_id", "file_path", F.when(dot > 0, F.substring_index("symbol_name", ".", 1)).otherwise("").alias("class_name"), F.substring_index("symbol_name", ".", -1).alias("name")
    )
    classes = rows.where("kind = 'class'").select("repo_id", "file_path", F.col("symbol_name").alias("name"))
    return graph.has_method(classes, functions)


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from files of the walk to their symbols."""
    files = table(spark, sf_dir, "source_files").select("repo_id", F.col("relative_path").alias("file_path"))
    symbols = table(spark, sf_dir, "chunks").select("repo_id", "file_path", F.lower(F.trim("symbol_type")).alias("kind"), F.col("symbol_name").alias("name"))
    return graph.contains(files, symbols)


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return graph.last_wins(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks indexed late over chunks indexed before; a match keeps its language."""
    rows = table(spark, sf_dir, "chunks").select("repo_id", "file_path", "symbol_name", "language", "start_line", "indexed_at", "chunk_id").where("symbol_name IS NOT NULL")
    keys = ["repo_id", "file_path", "symbol_name"]
    order = [F.col("indexed_at"), F.col("chunk_id")]
    late = F.col("indexed_at") >= F.lit("2018-01-20").cast("timestamp")
    old = graph.last_wins(rows.where(~late), keys, order)
    return graph.upsert(old, rows.where(late), keys, order, ("language",)).select(*keys, "language", "start_line", "chunk_id")


def detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of segment BUILDING go, and with them every edge that touches one."""
    orders = table(spark, sf_dir, "orders").select(F.lit("r").alias("repo_id"), F.col("o_orderkey").cast("string").alias("file_path"), "o_custkey")
    gone = orders.join(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    edges = table(spark, sf_dir, "lineitem").select(
        F.lit("r").alias("repo_id"), F.col("l_orderkey").cast("string").alias("caller_file"), (F.col("l_orderkey") + F.col("l_linenumber")).cast("string").alias("callee_file")
    )
    nodes, kept = graph.detach_delete(orders, edges, gone)
    left = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), F.lit("").alias("caller_file"), "n")
    per = kept.groupBy("caller_file").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "caller_file", "n")
    return left.unionByName(per)


def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the walk that no checkpoint lists."""
    return changes.unprocessed(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "checkpoints")).select("file_id", "repo_id", "relative_path")


def index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an index run per repository."""
    # The text is reduced to a flag before anything is shuffled.
    empty = F.col("content").isNull() | (F.col("content") == "")
    files = table(spark, sf_dir, "source_files").groupBy("repo_id", "file_id").agg(F.min(empty).alias("failed"))
    counted = files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("failed").alias("failed"), F.round(F.count_if("failed") / F.count(F.lit(1)), 6).alias("failure_rate")
    )
    symbols = table(spark, sf_dir, "chunks").groupBy("repo_id").agg(F.countDistinct("chunk_id").alias("symbols"), F.count(F.lit(1)).alias("attempted"))
    return counted.join(symbols, "repo_id", "left").select("repo_id", "files", "failed", "failure_rate", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("attempted", F.lit(0)).alias("attempted"))


def symbols_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols of all files."""
    files = table(spark, sf_dir, "source_files").groupBy("repo_id", "relative_path").agg(F.max(F.struct("walked_at", "content"))["content"].alias("content"))
    return parse_files(files).select("repo_id", "file_path", "kind", "ordinal", "name", "class_name", "start_line", "end_line", "language", "module_path", "caller_name")


def code_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges of all parsed files, calls attributed to the function they stand in."""
    files = table(spark, sf_dir, "source_files").groupBy("repo_id", "relative_path").agg(F.max(F.struct("walked_at", "content"))["content"].alias("content"))
    rows = parse_files(files)
    sites = rows.where("kind = 'call' AND caller_name <> ''").select("repo_id", "file_path", F.col("name").alias("callee_name"), "caller_name")
    functions = rows.where("kind = 'function'")
    return graph.call_edges(sites, functions, "enclosing")


_EDGES = "WITH edges AS (SELECT DISTINCT l_orderkey::VARCHAR AS caller, l_partkey::VARCHAR AS callee FROM lineitem) "
_CALLS = """
WITH sites AS (SELECT DISTINCT l_suppkey::VARCHAR AS file_path, l_partkey::VARCHAR AS callee_name FROM lineitem),
fns AS (SELECT regexp_extract(p_brand, '(\\d+)', 1) AS file_path, p_partkey::VARCHAR AS name, p_size AS ordinal FROM part),
resolved AS (
  SELECT s.file_path, s.callee_name, coalesce(a.file_path, b.file_path) AS callee_file FROM sites s
  LEFT JOIN fns a ON a.name = s.callee_name AND a.file_path = s.file_path LEFT JOIN fns b ON b.name = s.callee_name)
"""
QUERIES = {
    f.__name__: f
    for f in (
        call_neighbors, callsite_resolution, call_edges, first_function, has_method, contains, upsert_last_wins, upsert_merge,
        detach_delete, resume_skip, index_counters, symbols_extracted, code_call_edges,
    )
}
SQL = {
    "call_neighbors": _EDGES
    + """SELECT caller AS name, 'orders' AS file_path, 'callee' AS relation, callee AS neighbor FROM edges WHERE caller::BIGINT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT callee, 'parts', 'caller', caller FROM edges WHERE callee::BIGINT IN (SELECT p_partkey FROM part)""",
    "callsite_resolution": _CALLS + "SELECT * FROM resolved",
    "call_edges": _CALLS
    + """, firsts AS (SELECT file_path, arg_min(name, (ordinal, name)) AS caller_name FROM fns GROUP BY file_path)
    SELECT DISTINCT f.caller_name, r.file_path AS caller_file, r.callee_name, r.callee_file, r.file_path <> r.callee_file AS cross_file
    FROM resolved r JOIN firsts f USING (file_path) WHERE r.callee_file IS NOT NULL""",
    "first_function": """SELECT file_path, name FROM (SELECT l_orderkey::VARCHAR AS file_path, l_partkey::VARCHAR AS name,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR) AS rn FROM lineitem) WHERE rn = 1""",
    "has_method": """
WITH rows AS (SELECT repo_id, file_path, lower(trim(symbol_type)) AS kind, symbol_name FROM chunks WHERE symbol_name IS NOT NULL)
SELECT DISTINCT f.repo_id, f.file_path, split_part(f.symbol_name, '.', 1) AS class_name, string_split(f.symbol_name, '.')[-1] AS method
FROM rows f JOIN rows c ON c.kind = 'class' AND f.kind = 'function' AND contains(f.symbol_name, '.') AND c.repo_id = f.repo_id AND c.file_path = f.file_path
  AND c.symbol_name = split_part(f.symbol_name, '.', 1)""",
    "contains": """SELECT DISTINCT c.repo_id, c.file_path, lower(trim(c.symbol_type)) AS kind, c.symbol_name AS name FROM chunks c
      WHERE EXISTS (SELECT 1 FROM source_files s WHERE s.repo_id = c.repo_id AND s.relative_path = c.file_path)""",
    "upsert_last_wins": """SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "upsert_merge": """
WITH rows AS (SELECT * FROM chunks WHERE symbol_name IS NOT NULL),
ranked AS (SELECT *, indexed_at >= TIMESTAMP '2018-01-20' AS late FROM rows),
lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path, symbol_name, late ORDER BY indexed_at DESC, chunk_id DESC,
    language DESC NULLS LAST, start_line DESC NULLS LAST) AS rn FROM ranked) WHERE rn = 1),
n AS (SELECT * FROM lasts WHERE late), o AS (SELECT * FROM lasts WHERE NOT late)
SELECT n.repo_id, n.file_path, n.symbol_name, CASE WHEN o.chunk_id IS NOT NULL THEN o.language ELSE n.language END AS language, n.start_line, n.chunk_id
FROM n LEFT JOIN o ON o.repo_id = n.repo_id AND o.file_path = n.file_path AND o.symbol_name = n.symbol_name
UNION ALL SELECT o.repo_id, o.file_path, o.symbol_name, o.language, o.start_line, o.chunk_id FROM o
WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.repo_id = n.repo_id AND o.file_path = n.file_path AND o.symbol_name = n.symbol_name)""",
    "detach_delete": """
WITH gone AS (SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'),
kept AS (SELECT l_orderkey::VARCHAR AS caller_file FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM gone) AND l_orderkey + l_linenumber NOT IN (SELECT k FROM gone))
SELECT 'nodes' AS what, '' AS caller_file, count(*)::BIGINT AS n FROM orders WHERE o_orderkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'edges', caller_file, count(*)::BIGINT FROM kept GROUP BY caller_file""",
    "resume_skip": """SELECT file_id, repo_id, relative_path FROM source_files s WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT repo_id, unnest(processed_files) AS p FROM checkpoints) c WHERE c.repo_id = s.repo_id AND c.p = s.relative_path)""",
    "index_counters": """
WITH f AS (SELECT repo_id, file_id, min(content IS NULL OR content = '') AS failed FROM source_files GROUP BY repo_id, file_id),
c AS (SELECT repo_id, count(*)::BIGINT AS files, count(*) FILTER (WHERE failed)::BIGINT AS failed FROM f GROUP BY repo_id),
s AS (SELECT repo_id, count(DISTINCT chunk_id)::BIGINT AS symbols, count(*)::BIGINT AS attempted FROM chunks GROUP BY repo_id)
SELECT c.repo_id, files, failed, round(failed / files, 6) AS failure_rate, coalesce(symbols, 0) AS symbols, coalesce(attempted, 0) AS attempted FROM c LEFT JOIN s USING (repo_id)""",
}
