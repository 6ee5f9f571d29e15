"""Queries of symbol look-up and chunking (F8-F10, L1-L6, K1-K3, J9) over chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as text_functions
from codeloom.operators import chunking, lookup
from codeloom.parsing.extract import parse_files
from codeloom.session import table


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of named rows: customers, suppliers and parts."""
    return lookup.tagged(
        [
            ("function", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))),
            ("class", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))),
            ("type", table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))),
        ]
    )


def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exact(_kinds(spark, sf_dir), "red widget").select("symbol_type", "id", "name")


def lookup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_prefix(_kinds(spark, sf_dir), "Supplier#00000000").select("symbol_type", "id", "name")


def lookup_exact_else_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name with exact hits and one without; the second falls back to the prefix."""
    kinds = _kinds(spark, sf_dir)
    parts = [lookup.exact_else_prefix(kinds, name).select(F.lit(name).alias("asked"), "symbol_type", "id", "name") for name in ("Customer#000000007", "Customer#00000001")]
    return parts[0].unionByName(parts[1])


def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and classes of the chunk table by prefix, case-sensitive, one row per chunk."""
    rows = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
    kind = F.lower(text_functions.strip(F.col("symbol_type")))
    symbols = rows.select("chunk_id", F.col("symbol_name").alias("name"), kind.alias("symbol_type"))
    return lookup.by_prefix(symbols, "Dense").select("chunk_id", "name", "symbol_type")


def source_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the text of every (repository, file, symbol); one row per key, missing text is ''."""
    rows = table(spark, sf_dir, "chunks")
    keys = rows.select("repo_id", "file_path", "symbol_name").distinct()
    texts = rows.groupBy("repo_id", "file_path", "symbol_name").agg(F.min(F.struct("chunk_id", "source_text"))["source_text"].alias("t"))
    on = keys["repo_id"].eqNullSafe(texts["repo_id"]) & (keys["file_path"] == texts["file_path"]) & keys["symbol_name"].eqNullSafe(texts["symbol_name"])
    return keys.join(texts, on, "left").select(keys["repo_id"], keys["file_path"], keys["symbol_name"], F.length(F.coalesce("t", F.lit(""))).cast("long").alias("chars"))


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of all documents, 15 lines with 2 shared."""
    rows = table(spark, sf_dir, "documents")
    parts = chunking.split_symbols(rows.withColumn("name", F.lit("doc")), ["doc_id"], "name", "text", 15, 2)
    return parts.select("doc_id", "part_name", "start", "end", "part_text")


def chunk_lines_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of all symbols, 150 lines with 20 shared; each chunk once."""
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "symbol_name", "source_text").distinct()
    parts = chunking.split_symbols(rows, ["chunk_id"])
    return parts.select("chunk_id", "part_name", "start", "end", F.length("part_text").cast("long").alias("chars"))


def leading_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the comment above the declaration of each chunk begins: the first line of the whole text
    that is neither blank nor a comment, or the last line where there is none."""
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "source_text").where("source_text IS NOT NULL").distinct()
    lined = rows.select("chunk_id", text_functions.lines(F.col("source_text")).alias("lines"))
    declares = F.transform("lines", lambda x: ~F.regexp_replace(x, r"^\s+|\s+$", "").rlike(_NO_CODE))
    first = F.array_position(declares, True).cast("int")
    index = F.when(first > 0, first - 1).otherwise(F.size("lines") - 1)
    return lined.withColumn("line", index).select("chunk_id", "line", chunking.leading_comment_start(F.col("lines"), F.col("line")).alias("starts"))


def leading_comment_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the comment above each function and class of all files begins, in the whole text of the file."""
    files = table(spark, sf_dir, "source_files").groupBy("repo_id", "relative_path").agg(F.max(F.struct("walked_at", "content"))["content"].alias("content"))
    declared = parse_files(files).where("kind IN ('function', 'class')")
    heads = declared.groupBy("repo_id", "file_path").agg(F.collect_set(F.col("start_line") - 1).alias("heads"))
    joined = files.join(heads, files["repo_id"].eqNullSafe(heads["repo_id"]) & (files["relative_path"] == heads["file_path"])).select(files["repo_id"], "file_path", "content", "heads")
    lined = joined.withColumn("lines", text_functions.lines(F.regexp_replace("content", "\r\n?", "\n")))
    begins = F.transform("heads", lambda line: F.struct(line.alias("line"), chunking.leading_comment_start(F.col("lines"), line).alias("starts")))
    return lined.select("repo_id", "file_path", F.inline(begins))


#: A trimmed line that is blank or a comment.
_NO_CODE = r"^($|//|#|\*|\"{3}|'{3}|/\*)"

_KINDS = """
WITH kinds AS (
  SELECT 'function' AS symbol_type, c_custkey AS id, c_name AS name FROM customer
  UNION ALL SELECT 'class', s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'type', p_partkey, p_name FROM part)
"""


def _fallback(name: str) -> str:
    return f"""SELECT '{name}' AS asked, symbol_type, id, name FROM (
      SELECT *, min(rank) OVER () AS lowest FROM (SELECT *, CASE WHEN name = '{name}' THEN 0 ELSE 1 END AS rank FROM kinds WHERE starts_with(name, '{name}'))) WHERE rank = lowest"""


def _parts(keys: str, source: str, size: int, overlap: int, name: str, columns: str) -> str:
    stride = size - overlap
    return f"""
WITH lined AS (SELECT {keys}, {name} AS nm, string_split(body, chr(10)) AS ls FROM ({source}) WHERE body IS NOT NULL AND body <> ''),
counted AS (SELECT *, len(ls) AS n, CASE WHEN len(ls) <= {size} THEN -1 ELSE CAST(ceil((len(ls) - {size}) / {stride}.0) AS INTEGER) END AS m FROM lined),
numbered AS (SELECT *, unnest(range(0, m + 2)) AS k FROM counted),
cut AS (SELECT *, CASE WHEN m < 0 THEN 0 WHEN k <= m THEN k * {stride} ELSE n - {overlap} END AS s,
  CASE WHEN m < 0 THEN n WHEN k <= m THEN least(k * {stride} + {size}, n) ELSE n END AS e FROM numbered)
SELECT {keys}, CASE WHEN m < 0 THEN nm ELSE coalesce(nm, '') || ' [part ' || (k + 1) || ']' END AS part_name, s::INTEGER AS start, e::INTEGER AS "end", {columns} FROM cut"""


QUERIES = {
    f.__name__: f
    for f in (lookup_exact, lookup_prefix, lookup_exact_else_prefix, symbol_lookup, source_text_lookup, chunk_lines, chunk_lines_full, leading_comment, leading_comment_declared)
}
SQL = {
    "lookup_exact": _KINDS + "SELECT symbol_type, id, name FROM kinds WHERE name = 'red widget'",
    "lookup_prefix": _KINDS + "SELECT symbol_type, id, name FROM kinds WHERE starts_with(name, 'Supplier#00000000')",
    "lookup_exact_else_prefix": _KINDS + _fallback("Customer#000000007") + " UNION ALL " + _fallback("Customer#00000001"),
    "symbol_lookup": "SELECT DISTINCT chunk_id, symbol_name AS name, lower(trim(symbol_type)) AS symbol_type FROM chunks WHERE starts_with(symbol_name, 'Dense')",
    "source_text_lookup": """SELECT repo_id, file_path, symbol_name, length(coalesce(arg_min(source_text, chunk_id), ''))::BIGINT AS chars
      FROM chunks GROUP BY repo_id, file_path, symbol_name""",
    "chunk_lines": _parts("doc_id", "SELECT doc_id, text AS body FROM documents", 15, 2, "'doc'", "array_to_string(ls[s + 1:e], chr(10)) AS part_text"),
    "chunk_lines_full": _parts(
        "chunk_id", "SELECT DISTINCT chunk_id, symbol_name, source_text AS body FROM chunks", 150, 20, "symbol_name", "length(array_to_string(ls[s + 1:e], chr(10)))::BIGINT AS chars"
    ),
    "leading_comment": r"""
WITH RECURSIVE lined AS (
  SELECT chunk_id, string_split(source_text, chr(10)) AS ls FROM (SELECT DISTINCT chunk_id, source_text FROM chunks WHERE source_text IS NOT NULL)),
placed AS (SELECT *, list_position(list_transform(ls, lambda x: NOT regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^($|//|#|\*|"{3}|''{3}|/\*)')), true) AS p FROM lined),
start AS (SELECT chunk_id, CASE WHEN p > 0 THEN ls[:p] ELSE ls END AS ls, CASE WHEN p > 0 THEN p - 1 ELSE len(ls) - 1 END AS line FROM placed),
fold AS (
  SELECT chunk_id, ls, line, line AS result, line - 1 AS pos, 0 AS blanks, false AS stopped FROM start
  UNION ALL
  SELECT chunk_id, ls, line,
    CASE WHEN t <> '' AND regexp_matches(t, '^(//|#|\*|"{3}|''{3}|/\*)') THEN pos ELSE result END,
    pos - 1, CASE WHEN t = '' THEN blanks + 1 ELSE 0 END,
    (t = '' AND blanks + 1 >= 2) OR (t <> '' AND NOT regexp_matches(t, '^(//|#|\*|"{3}|''{3}|/\*)'))
  FROM (SELECT *, regexp_replace(ls[pos + 1], '^\s+|\s+$', '', 'g') AS t FROM fold WHERE pos >= 0 AND NOT stopped))
SELECT chunk_id, line::INTEGER AS line, CASE WHEN line <= 0 THEN 0 ELSE min(result) END::INTEGER AS starts FROM fold GROUP BY chunk_id, line""",
}
