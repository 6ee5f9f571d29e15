"""Change feed operators: parsing, applying, deciding on the kind of run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths


def parse_status_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Input plus status (A, M, D, R), path and old_path of name-status lines; other lines go."""
    fields = F.split(F.col(line), "\t")
    code = fields[0]
    renamed = code.startswith("R")
    status = F.when(renamed, F.lit("R")).when(code.isin("A", "M", "D"), code)
    path = F.when(renamed, F.get(fields, F.lit(2))).otherwise(F.get(fields, F.lit(1)))
    old = F.when(renamed, F.get(fields, F.lit(1)))
    return lines.withColumns({"status": status, "path": path, "old_path": old}).where("status IS NOT NULL")


def indexed(changes: DataFrame) -> DataFrame:
    """Changes with a known language on either side and no noise path."""
    new, old = F.col("path"), F.col("old_path")

    def source(p: Column) -> Column:
        return F.coalesce(paths.language(p).isNotNull() & ~paths.in_noise_directory(p) & ~paths.has_noise_suffix(p), F.lit(False))

    return changes.where(source(new) | source(old))


def touched(changes: DataFrame) -> DataFrame:
    """Paths whose rows go before new ones are added: both sides of every change."""
    sides = F.array_compact(F.array("path", F.when(F.col("status") == "R", F.col("old_path"))))
    return changes.select("repo_id", F.explode(sides).alias("file_path")).distinct()


def apply(existing: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of touched files replaced by the fresh rows of added, modified and renamed files.

    Applying a change twice gives the same table.
    """
    alive = changes.where(F.col("status") != "D").select("repo_id", F.col("path").alias("file_path")).distinct()
    added = fresh.join(alive, ["repo_id", "file_path"], "left_semi")
    return existing.join(touched(changes), ["repo_id", "file_path"], "left_anti").unionByName(added.select(*existing.columns))


def run_mode(requested: str, baseline: str | None, head: str | None, has_clone: bool) -> str:
    """``full``, ``resume``, ``incremental`` or ``none``."""
    if requested == "resume":
        return "resume"
    if requested == "incremental":
        if not baseline or not has_clone:
            return "full"
        return "none" if baseline == head else "incremental"
    return "full"


def unprocessed(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Files that no checkpoint of their repository lists."""
    done = checkpoints.select("repo_id", F.explode("processed_files").alias("relative_path")).where("relative_path IS NOT NULL").distinct()
    return files.join(done, ["repo_id", "relative_path"], "left_anti")
