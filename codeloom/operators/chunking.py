"""Source chunks of symbols: leading comments, overlapping parts (K1-K3). Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as text_functions

CHUNK_LINES, OVERLAP_LINES = 150, 20

# A trimmed line that starts so is a comment line.
COMMENT_STARTS = ("//", "#", "*", '"""', "'''", "/*")


def _is_comment(line: Column) -> Column:
    out = F.lit(False)
    for start in COMMENT_STARTS:
        out = out | line.startswith(start)
    return out


def leading_comment_start(lines: Column, index: Column) -> Column:
    """0-based line at which the comment above line ``index`` (0-based) begins.

    A fold over the lines above, nearest first: one blank line is tolerated, two in a row or a
    line of code stop it. Without a comment the result is ``index``; it is never below 0.
    """
    state = F.struct(
        index.cast("int").alias("result"),
        (index - 1).cast("int").alias("at"),
        F.lit(0).alias("blanks"),
        F.lit(False).alias("stopped"),
    )

    def step(acc: Column, line: Column) -> Column:
        trimmed = text_functions.strip(line)
        blank = trimmed == ""
        comment = _is_comment(trimmed)
        going = ~acc["stopped"]
        blanks = F.when(blank, acc["blanks"] + 1).otherwise(0)
        return F.struct(
            F.when(going & ~blank & comment, acc["at"]).otherwise(acc["result"]).alias("result"),
            (acc["at"] - 1).alias("at"),
            blanks.alias("blanks"),
            (acc["stopped"] | (blanks >= 2) | (~blank & ~comment)).alias("stopped"),
        )

    above = F.reverse(F.slice(lines, F.lit(1), F.greatest(index, F.lit(0))))
    return F.when(index <= 0, F.lit(0)).otherwise(F.aggregate(above, state, step, lambda acc: acc["result"]))


def part_ranges(count: Column, size: int = CHUNK_LINES, overlap: int = OVERLAP_LINES) -> Column:
    """Parts of ``count`` lines as an array of (part, start, end), 0-based, end exclusive.

    Up to ``size`` lines are one part with number 0. Longer symbols have parts of ``size`` lines
    at a stride of ``size - overlap``, numbered from 1, and a last part with the final
    ``overlap`` lines.
    """
    stride = size - overlap
    full = F.ceil((count - size) / stride).cast("int")
    one = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("start"), count.cast("int").alias("end")))
    several = F.transform(
        F.sequence(F.lit(0), full + 1),
        lambda k: F.struct(
            (k + 1).alias("part"),
            F.when(k <= full, k * stride).otherwise(count - overlap).cast("int").alias("start"),
            F.when(k <= full, F.least(k * stride + size, count)).otherwise(count).cast("int").alias("end"),
        ),
    )
    return F.when(count <= size, one).otherwise(several)


def split_symbols(symbols: DataFrame, keep: list[str], name: str = "symbol_name", text: str = "source_text", size: int = CHUNK_LINES, overlap: int = OVERLAP_LINES) -> DataFrame:
    """One row per part: ``keep`` columns, part name, start and end (0-based lines) and text.

    Null and empty texts have no parts. Map-only.
    """
    body = symbols.where(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("_cl_lines", text_functions.lines(F.col(text)))
    exploded = body.select(*keep, name, "_cl_lines", F.explode(part_ranges(F.size("_cl_lines"), size, overlap)).alias("_cl_part"))
    label = F.when(F.col("_cl_part.part") == 0, F.col(name)).otherwise(F.format_string("%s [part %d]", F.coalesce(name, F.lit("")), "_cl_part.part"))
    return exploded.select(
        *keep,
        label.alias("part_name"),
        F.col("_cl_part.start").alias("start"),
        F.col("_cl_part.end").alias("end"),
        F.array_join(F.slice("_cl_lines", F.col("_cl_part.start") + 1, F.col("_cl_part.end") - F.col("_cl_part.start")), "\n").alias("part_text"),
    )


def extract_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks of all functions and classes of parsed files (K3).

    ``files``: repo_id, file_path, content. ``symbols``: repo_id, file_path, kind, name,
    class_name, start_line, end_line (1-based), language. Methods are named ``Class.method``;
    the bare name and the class are kept beside it, so look-ups need no parsing of names.
    """
    wanted = symbols.where(F.col("kind").isin("function", "class"))
    joined = wanted.join(files.select("repo_id", "file_path", "content"), ["repo_id", "file_path"]).where("content <> ''")
    lined = joined.withColumn("_cl_all", text_functions.lines(F.col("content")))
    begin = leading_comment_start(F.col("_cl_all"), F.col("start_line") - 1)
    cut = lined.withColumn("_cl_begin", begin).withColumn("_cl_count", F.greatest(F.col("end_line") - F.col("_cl_begin"), F.lit(0)))
    full_name = F.when((F.col("kind") == "function") & (F.col("class_name") != ""), F.concat_ws(".", "class_name", "name")).otherwise(F.col("name"))
    parts = cut.withColumn("_cl_part", F.explode(part_ranges(F.col("_cl_count"))))
    start = F.col("_cl_begin") + F.col("_cl_part.start")
    label = F.when(F.col("_cl_part.part") == 0, full_name).otherwise(F.format_string("%s [part %d]", full_name, "_cl_part.part"))
    return parts.select(
        "repo_id",
        "file_path",
        label.alias("symbol_name"),
        F.col("name").alias("base_name"),
        "class_name",
        F.col("kind").alias("symbol_type"),
        (start + 1).alias("start_line"),
        (F.col("_cl_begin") + F.col("_cl_part.end")).alias("end_line"),
        "language",
        F.array_join(F.slice("_cl_all", start + 1, F.col("_cl_part.end") - F.col("_cl_part.start")), "\n").alias("source_text"),
    ).where("source_text <> ''")
