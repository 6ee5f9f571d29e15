"""Queries of paths, change feeds, triggers and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as text_functions
from codeloom.operators import changes
from codeloom.sources import registry, walk
from codeloom.session import table
from codeloom.streaming import triggers


HALF_HOUR = 30 * 60 * 1_000_000


def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files").select("file_id", "relative_path").distinct()
    path = F.col("relative_path")
    return files.select("file_id", paths.extension(path).alias("extension"), paths.language(path).alias("path_language"), paths.has_noise_suffix(path).alias("noise_suffix"))


def walk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an indexing walk would give, with a limit of 20,000 bytes."""
    files = table(spark, sf_dir, "source_files").select("file_id", "relative_path", "content")
    return walk.filter_walk(files, 20_000).select("file_id", "path_language").distinct()


def parse_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-status lines written from the feed and parsed again; other statuses go."""
    feed = table(spark, sf_dir, "file_changes").select("change_id", F.concat_ws("\t", "status", "old_path", "path").alias("line"))
    return changes.parse_status_lines(feed).select("change_id", "status", "path", "old_path")


def indexed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose new or old path is a source file outside noise directories."""
    return changes.indexed(table(spark, sf_dir, "file_changes")).select("change_id")


def incremental_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of status F are deleted, those of status O come back with a new total, the rest stays."""
    orders = table(spark, sf_dir, "orders").select(F.lit("r").alias("repo_id"), F.col("o_orderkey").cast("string").alias("file_path"), "o_totalprice", "o_orderstatus")
    delta = orders.where("o_orderstatus IN ('F', 'O')").select(
        "repo_id", F.when(F.col("o_orderstatus") == "F", "D").otherwise("M").alias("status"), F.col("file_path").alias("path"), F.lit(None).cast("string").alias("old_path")
    )
    fresh = orders.withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    return changes.apply(orders, delta, fresh).select("file_path", "o_totalprice", "o_orderstatus")


def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triggers.debounce(table(spark, sf_dir, "events"), "user_id", "ts", HALF_HOUR)
    return rows.select("user_id", "first_trigger", "fires_at", "triggers")


def lock_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires of the debounce that start a run of six hours, and those that are dropped."""
    fires = triggers.debounce(table(spark, sf_dir, "events"), "user_id", "ts", HALF_HOUR).select("user_id", "fires_at")
    return triggers.drop_while_running(fires, "user_id", "fires_at", 6 * 3600 * 1_000_000).select("user_id", "fires_at", "runs")


def list_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.normalised(table(spark, sf_dir, "repos")).select("id", "name", "url", "branch")


def resolve_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every repository the one its upper-cased name resolves to: the first added."""
    repos = registry.normalised(table(spark, sf_dir, "repos"))
    first = repos.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("added_at", "id"))["id"].alias("resolved"))
    return repos.join(first, F.lower(F.upper("name")) == F.col("key")).select("id", "resolved")


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions over whole document texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").distinct()
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.md5(text_functions.strip(text)).alias("stripped"),
        F.size(text_functions.lines(text)).alias("lines"),
        text_functions.utf16_length(text).alias("utf16"),
        F.md5(text_functions.signature(text)).alias("signature"),
        F.md5(text_functions.quoted(text)).alias("quoted"),
        text_functions.estimated_tokens(text).alias("tokens"),
    )


def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the last run per repository: one row, paths once."""
    from codeloom.operators.incremental import latest_checkpoints

    rows = latest_checkpoints(table(spark, sf_dir, "checkpoints"))
    return rows.select("repo_id", "updated_at", "last_commit", F.size(F.array_distinct(F.coalesce("processed_files", F.array().cast("array<string>")))).alias("processed"))


_NOISE = r"'(^|/)(node_modules|\.git|dist|build|target|vendor|__pycache__)/'"
_LANG = """CASE {ext} WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.py' THEN 'python'
  WHEN '.rs' THEN 'rust' WHEN '.go' THEN 'go' WHEN '.cpp' THEN 'cpp' WHEN '.cc' THEN 'cpp' WHEN '.h' THEN 'cpp' WHEN '.hpp' THEN 'cpp' END"""


def _ext(path: str) -> str:
    return rf"lower(regexp_extract({path}, '[^./\\](\.[^./\\]*)$', 1))"


def _source(path: str) -> str:
    return rf"coalesce({_LANG.format(ext=_ext(path))} IS NOT NULL AND NOT regexp_matches({path}, {_NOISE}) AND NOT (ends_with({path}, '.min.js') OR ends_with({path}, '.d.ts')), false)"


_SESSIONS = """
WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM marked),
fires AS (SELECT user_id, min(ts) AS first_trigger, max(ts) + INTERVAL 30 MINUTE AS fires_at, count(*)::BIGINT AS triggers FROM runs GROUP BY user_id, g)
"""
QUERIES = {
    f.__name__: f
    for f in (
        language_map, walk_filter, parse_diff, indexed_changes, incremental_apply, debounce, lock_drop, list_repos, resolve_repo,
        scalar_functions, checkpoint_latest,
    )
}
_REPOS = r"""
WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC NULLS LAST, url DESC NULLS LAST, name DESC NULLS LAST, branch DESC NULLS LAST) AS rn FROM repos WHERE id IS NOT NULL) WHERE rn = 1),
named AS (SELECT id, CASE WHEN coalesce(trim(name), '') = '' THEN regexp_replace(string_split(url, '/')[-1], '\.git$', '') ELSE lower(trim(name)) END AS name, url, coalesce(lower(branch), 'main') AS branch, added_at FROM one)
"""
SQL = {
    "language_map": f"""SELECT DISTINCT file_id, {_ext('relative_path')} AS extension, {_LANG.format(ext=_ext('relative_path'))} AS path_language,
      ends_with(relative_path, '.min.js') OR ends_with(relative_path, '.d.ts') AS noise_suffix FROM source_files""",
    "walk_filter": rf"""
WITH f AS (SELECT file_id, regexp_replace(relative_path, '^\./', '') AS p, content FROM source_files)
SELECT DISTINCT file_id, {_LANG.format(ext=_ext('p'))} AS path_language FROM f WHERE {_source('p')} AND octet_length(encode(content)) <= 20000""",
    "parse_diff": """
WITH f AS (SELECT change_id, CASE WHEN left(concat_ws(chr(9), status, old_path, path), 1) = 'R' THEN 'R' ELSE string_split(concat_ws(chr(9), status, old_path, path), chr(9))[1] END AS code,
  string_split(concat_ws(chr(9), status, old_path, path), chr(9)) AS p FROM file_changes)
SELECT change_id, code AS status, CASE WHEN code = 'R' THEN p[3] ELSE p[2] END AS path, CASE WHEN code = 'R' THEN p[2] END AS old_path FROM f WHERE code IN ('A', 'M', 'D', 'R')""",
    "indexed_changes": f"SELECT change_id FROM file_changes WHERE {_source('path')} OR {_source('old_path')}",
    "incremental_apply": """SELECT o_orderkey::VARCHAR AS file_path, CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, o_orderstatus
      FROM orders WHERE o_orderstatus <> 'F'""",
    "debounce": _SESSIONS + "SELECT user_id, first_trigger, fires_at, triggers FROM fires",
    "lock_drop": "WITH RECURSIVE"
    + _SESSIONS.strip().removeprefix("WITH")
    + """, numbered AS (SELECT user_id, fires_at, row_number() OVER (PARTITION BY user_id ORDER BY fires_at) AS i FROM fires),
walk AS (
  SELECT user_id, fires_at, i, true AS runs, fires_at + INTERVAL 6 HOUR AS busy FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.user_id, n.fires_at, n.i, n.fires_at >= w.busy, CASE WHEN n.fires_at >= w.busy THEN n.fires_at + INTERVAL 6 HOUR ELSE w.busy END
  FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.i = w.i + 1)
SELECT user_id, fires_at, runs FROM walk""",
    "list_repos": _REPOS + "SELECT id, name, url, branch FROM named",
    "resolve_repo": _REPOS + ", first AS (SELECT lower(name) AS k, arg_min(id, (added_at, id)) AS resolved FROM named GROUP BY lower(name)) SELECT n.id, f.resolved FROM named n JOIN first f ON lower(upper(n.name)) = f.k",
    "scalar_functions": r"""SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped, len(string_split(text, chr(10)))::INTEGER AS lines,
      (length(text) + length(regexp_replace(text, '[\x{0}-\x{FFFF}]', '', 'g')))::INTEGER AS utf16, md5(substring(text, 1, 200)) AS signature,
      md5(replace(text, '''', '''''')) AS quoted, ceil(length(text) / 4.0)::BIGINT AS tokens FROM (SELECT DISTINCT doc_id, text FROM documents)""",
    "checkpoint_latest": """SELECT repo_id, updated_at, last_commit, len(list_distinct(coalesce(processed_files, [])))::INTEGER AS processed FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY updated_at DESC, last_commit DESC NULLS LAST) AS rn FROM checkpoints WHERE repo_id IS NOT NULL AND updated_at IS NOT NULL) WHERE rn = 1""",
}
