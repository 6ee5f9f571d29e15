"""Context bundles: seeds within a budget, then related code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import first_wins

DEFAULT_TOKENS, CHARS_PER_TOKEN, SEEDS = 4_000, 4, 20
EMPTY_BUNDLE = "No relevant code found for this task."


def budget_chars(max_tokens: int = DEFAULT_TOKENS) -> int:
    return max_tokens * CHARS_PER_TOKEN


def first_occurrences(rows: DataFrame, group: list[str], key: list[str], rank: list[Column]) -> DataFrame:
    """First row of each key within a group by rank.

    An aggregation with a partial step per task: a text with very many copies costs one row per task.
    """
    return first_wins(rows, [*group, *key], rank)


def fill_seeds(rows: DataFrame, group: list[str], rank: list[Column], size: Column, budget: int, parts: int = 16) -> DataFrame:
    """Rows in rank order up to the first that would overflow the budget, with ``used``.

    Sizes are not negative, so the running sum is monotone and stopping is a filter on it. A group
    is first cut in ``parts``: a row that overflows the budget within its part alone is behind the
    stop in the whole group, so only a bounded rest of a hot group is summed up in one task.
    """
    part = F.pmod(F.xxhash64(*rank), F.lit(parts))
    inner = Window.partitionBy(*group, "_cl_part").orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
    rest = rows.withColumn("_cl_part", part).withColumn("_cl_used", F.sum(size).over(inner)).where(F.col("_cl_used") <= budget).drop("_cl_part", "_cl_used")
    w = Window.partitionBy(*group).orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
    return rest.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def _fold(items: Column, used: Column, budget: int) -> Column:
    """First-fit fold over ordered items (size, payload): (used, kept payloads, budget hit)."""
    kind = "struct<used:bigint,kept:array<bigint>,hit:boolean>"
    start = F.struct(used.cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept"), F.lit(False).alias("hit")).cast(kind)

    def step(acc: Column, item: Column) -> Column:
        full = acc["used"] >= budget
        empty = item["size"] == 0
        over = acc["used"] + item["size"] > budget
        add = ~full & ~empty & ~over
        return F.struct(
            F.when(add, acc["used"] + item["size"]).otherwise(acc["used"]).cast("bigint").alias("used"),
            F.when(add, F.array_append(acc["kept"], item["id"])).otherwise(acc["kept"]).alias("kept"),
            (acc["hit"] | full | (~empty & over)).alias("hit"),
        ).cast(kind)

    return F.aggregate(items, start, step)


def fill_related(candidates: DataFrame, seeds: DataFrame, group: list[str], rank: Column, item: str, size: Column, budget: int) -> DataFrame:
    """Per group: characters used, related items kept and whether the budget was hit.

    Candidates are taken in rank order; one that does not fit is skipped, not a stop. ``seeds``:
    group columns, ``used``. A bundle's candidates are bounded (neighbours of at most 20 seeds), so
    they are folded in one expression. Groups without candidates keep their seeds' total.
    """
    entries = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.col(item).cast("bigint").alias("id"), size.cast("bigint").alias("size"))))
    listed = candidates.groupBy(*group).agg(entries.alias("_cl_items"))
    totals = seeds.groupBy(*group).agg(F.max("used").alias("_cl_used"))
    none = F.array().cast("array<struct<rank:int,id:bigint,size:bigint>>")
    joined = totals.join(listed, group, "left")
    items = F.when(F.col("_cl_items").isNull(), F.transform(none, lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size")))).otherwise(
        F.transform("_cl_items", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size")))
    )
    folded = joined.withColumn("_cl_fold", _fold(items, F.coalesce("_cl_used", F.lit(0)), budget))
    return folded.select(
        *group, F.col("_cl_fold.used").alias("total_chars"), F.col("_cl_fold.kept").alias("related"), F.col("_cl_fold.hit").alias("budget_reached")
    )


def format_chunk(name: Column, file_path: Column, start: Column, end: Column, language: Column, text: Column, note: Column) -> Column:
    """Markdown of one chunk; line numbers of 0 are unknown."""
    where = F.when(start == 0, F.lit("lines unknown")).otherwise(F.format_string("lines %d-%d", start, end))
    tail = F.when(note.isNull(), F.lit("")).otherwise(F.concat(F.lit(" — "), note))
    return F.concat(F.lit("### "), name, tail, F.lit("\n"), file_path, F.lit(" ("), where, F.lit(")\n```"), language, F.lit("\n"), text, F.lit("\n```"))


def format_bundle(chunks: DataFrame) -> DataFrame:
    """One Markdown text of ordered chunks (section, rank, markdown); a fixed message if there are none."""
    parts = chunks.groupBy().agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == "seed", F.struct("rank", "markdown")))), lambda x: x["markdown"]), "\n\n").alias("seeds"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == "related", F.struct("rank", "markdown")))), lambda x: x["markdown"]), "\n\n").alias("related"),
        F.count(F.lit(1)).alias("n"),
    )
    text = F.concat(F.lit("## Relevant Code\n\n"), F.col("seeds"), F.lit("\n\n## Related Code\n\n"), F.col("related"))
    return parts.select(F.when(F.col("n") == 0, F.lit(EMPTY_BUNDLE)).otherwise(text).alias("bundle"))
