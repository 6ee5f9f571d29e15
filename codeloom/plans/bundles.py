"""Queries of context bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import bundle, search
from codeloom.session import table

BUDGET = bundle.budget_chars()


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository of the documents: texts once, in the order of their ids, while they fit."""
    docs = table(spark, sf_dir, "documents").where("repo_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "repo_id", "text")
    once = bundle.first_occurrences(docs, ["repo_id"], ["text"], [F.col("doc_id")])
    return bundle.fill_seeds(once, ["repo_id"], [F.col("doc_id")], F.length("text"), BUDGET)


def bundle_seed_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir).select("repo_id", "doc_id", "used")


def bundle_related_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit fold of each customer's orders (sizes from their prices) after seeds of a third of the budget."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.floor(F.col("o_totalprice")) % 9000).cast("long").alias("size"))
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(BUDGET // 3).cast("long").alias("used"))
    filled = bundle.fill_related(orders, seeds, ["o_custkey"], F.col("o_orderkey").cast("int"), "o_orderkey", F.col("size"), BUDGET)
    return filled.select("o_custkey", "total_chars", F.array_join(F.col("related").cast("array<string>"), ",").alias("related"), "budget_reached")


def context_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by similarity to row 0; related rows share a label with a seed; sizes are id-derived lengths."""
    rows = table(spark, sf_dir, "embeddings").withColumn("size", (F.col("vec_id") * 37 % 1900 + 100).cast("long"))
    query = rows.where("vec_id = 0").select("embedding").first()
    hits = search.vector_search(rows, list(query[0]) if query else [0.0], "embedding", "vec_id", k=bundle.SEEDS, min_score=0.3)
    placed = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "vec_id"))).withColumn("grp", F.lit(1))
    seeds = bundle.fill_seeds(placed, ["grp"], [F.col("rank")], F.col("size"), BUDGET)
    labels = F.broadcast(seeds.groupBy("label").agg(F.min("rank").alias("seed_rank")))
    near = rows.join(labels, "label").join(F.broadcast(seeds.select("vec_id")), "vec_id", "left_anti").withColumn("grp", F.lit(1))
    ordered = near.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("seed_rank", "vec_id")))
    filled = bundle.fill_related(ordered, seeds, ["grp"], F.col("place"), "vec_id", F.col("size"), BUDGET)
    listed = seeds.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("seeds"))
    return filled.join(listed, "grp").select("seeds", F.array_join(F.col("related").cast("array<string>"), ",").alias("related"), "total_chars", "budget_reached")


def bundle_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of every chunk, lines unknown where there is no end."""
    return _markdown(table(spark, sf_dir, "chunks"))


def _markdown(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("chunk_id", "symbol_name", "file_path", "start_line", "end_line", "language", "source_text").distinct()
    start = F.when(F.col("end_line").isNull() | F.col("start_line").isNull(), 0).otherwise(F.col("start_line"))
    text = bundle.format_chunk(
        F.coalesce("symbol_name", F.lit("?")), F.col("file_path"), start, F.coalesce("end_line", F.lit(0)), F.coalesce("language", F.lit("")), F.col("source_text"), F.lit(None).cast("string")
    )
    return rows.select("chunk_id", F.md5(text).alias("markdown"))


_FOLD = """
fold AS (
  SELECT {key}, items, {used} AS used, [] ::BIGINT[] AS kept, false AS hit, 1 AS i FROM start
  UNION ALL
  SELECT {key}, items,
    CASE WHEN used < {budget} AND items[i].size <> 0 AND used + items[i].size <= {budget} THEN used + items[i].size ELSE used END,
    CASE WHEN used < {budget} AND items[i].size <> 0 AND used + items[i].size <= {budget} THEN list_append(kept, items[i].id) ELSE kept END,
    hit OR used >= {budget} OR (items[i].size <> 0 AND used + items[i].size > {budget}), i + 1
  FROM fold WHERE i <= coalesce(len(items), 0))
"""
QUERIES = {f.__name__: f for f in (bundle_seed_fill, bundle_related_fill, context_bundle, bundle_markdown)}
SQL = {
    "bundle_seed_fill": f"""
WITH once AS (SELECT repo_id, text, min(doc_id) AS doc_id FROM documents WHERE repo_id IS NOT NULL AND text IS NOT NULL GROUP BY repo_id, text)
SELECT repo_id, doc_id, used FROM (SELECT *, sum(length(text)) OVER (PARTITION BY repo_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM once) WHERE used <= {BUDGET}""",
    "bundle_related_fill": f"""
WITH RECURSIVE start AS (
  SELECT c_custkey AS o_custkey, (SELECT list({{'id': o_orderkey, 'size': (floor(o_totalprice)::BIGINT % 9000)}} ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS items FROM customer),
{_FOLD.format(key="o_custkey", used=BUDGET // 3, budget=BUDGET)}
SELECT o_custkey, used::BIGINT AS total_chars, array_to_string(kept, ',') AS related, hit AS budget_reached FROM fold WHERE i = coalesce(len(items), 0) + 1""",
    "context_bundle": f"""
WITH RECURSIVE q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
r AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q.v) AS s, (vec_id * 37 % 1900 + 100)::BIGINT AS size FROM embeddings, q),
hits AS (SELECT * FROM (SELECT * FROM r ORDER BY s DESC, vec_id LIMIT 20) WHERE s >= 0.3),
placed AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM hits),
seeds AS (SELECT * FROM (SELECT *, sum(size) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM placed) WHERE used <= {BUDGET}),
labels AS (SELECT label, min(rank) AS seed_rank FROM seeds GROUP BY label),
start AS (SELECT 1 AS grp, (SELECT max(used)::BIGINT FROM seeds) AS u0,
  (SELECT list({{'id': vec_id, 'size': size}} ORDER BY seed_rank, vec_id) FROM r JOIN labels USING (label) WHERE vec_id NOT IN (SELECT vec_id FROM seeds)) AS items),
{_FOLD.format(key="grp", used="u0", budget=BUDGET)}
SELECT (SELECT string_agg(vec_id, ',' ORDER BY rank) FROM seeds) AS seeds, array_to_string(kept, ',') AS related, used::BIGINT AS total_chars, hit AS budget_reached
FROM fold WHERE i = coalesce(len(items), 0) + 1""",
    "bundle_markdown": """
SELECT chunk_id, md5('### ' || coalesce(symbol_name, '?') || chr(10) || file_path || ' (' ||
  CASE WHEN end_line IS NULL OR start_line IS NULL OR start_line = 0 THEN 'lines unknown' ELSE 'lines ' || start_line || '-' || end_line END
  || ')' || chr(10) || '```' || coalesce(language, '') || chr(10) || source_text || chr(10) || '```') AS markdown
FROM (SELECT DISTINCT chunk_id, symbol_name, file_path, start_line, end_line, language, source_text FROM chunks)""",
}
