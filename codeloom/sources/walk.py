"""Walking a checkout and reading its files.

The walk is driven by an explicit list of paths: a directory scan of the file source would drop
names that start with an underscore or a dot, and empty files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import LANGUAGE_BY_EXTENSION, NOISE_DIRECTORIES, NOISE_SUFFIXES, has_noise_suffix, in_noise_directory, language

MAX_FILE_BYTES = 1_048_576
FILES = "repo_id string, relative_path string, absolute_path string, language string, size long"


def _list(root: str, limit: int, skipped: list[tuple[str, str]] | None) -> Iterator[tuple[str, str, str, int]]:
    for folder, folders, names in os.walk(root, followlinks=False):
        folders[:] = sorted(d for d in folders if d not in NOISE_DIRECTORIES and not os.path.islink(os.path.join(folder, d)))
        for name in sorted(names):
            path = os.path.join(folder, name)
            suffix = os.path.splitext(name)[1].lower()
            if name.endswith(NOISE_SUFFIXES) or suffix not in LANGUAGE_BY_EXTENSION or os.path.islink(path) or not os.path.isfile(path):
                continue
            size = os.path.getsize(path)
            relative = os.path.relpath(path, root).replace(os.sep, "/")
            if size > limit:
                if skipped is not None:
                    skipped.append((relative, "too-large"))
                continue
            yield relative, path, LANGUAGE_BY_EXTENSION[suffix], size


def walk_repo(spark: SparkSession, root: str, repo_id: str, max_file_bytes: int = MAX_FILE_BYTES, skipped: list[tuple[str, str]] | None = None) -> DataFrame:
    """Source files of a checkout; ``skipped`` receives files over the size limit and the reason."""
    rows = [(repo_id, *entry) for entry in _list(root, max_file_bytes, skipped)]
    return spark.createDataFrame(rows, FILES)


def walk_repos(spark: SparkSession, roots: DataFrame, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Source files of many checkouts (repo_id, root) on shared storage, one task per checkout."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = [(r.repo_id, *entry) for entry in _list(r.root, max_file_bytes, None)]
                yield pd.DataFrame(rows, columns=["repo_id", "relative_path", "absolute_path", "language", "size"])

    return roots.select("repo_id", "root").repartition("repo_id").mapInPandas(run, FILES)


def filter_walk(files: DataFrame, max_file_bytes: int = MAX_FILE_BYTES, path: str = "relative_path") -> DataFrame:
    """The same filters over a table of paths; the size is that of the content in UTF-8."""
    p = F.regexp_replace(F.col(path), r"^\./", "")
    keep = ~in_noise_directory(p) & ~has_noise_suffix(p) & language(p).isNotNull() & (F.octet_length("content") <= max_file_bytes)
    return files.withColumn("path_language", language(p)).where(keep)


def read_files(files: DataFrame, per_task: int = 2_000) -> DataFrame:
    """Input plus ``content``: bytes read as UTF-8, invalid ones replaced; null on an I/O error."""

    @F.pandas_udf("string")
    def read(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str | None:
            try:
                with open(path, "rb") as f:
                    return f.read().decode("utf-8", "replace")
            except OSError:
                return None

        return paths.map(one)

    return files.withColumn("content", read("absolute_path"))
