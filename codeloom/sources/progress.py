"""Progress events of index runs as an append-only table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schemas import PROGRESS
from codeloom.sources.tables import Tables

# The events a run reports.
EVENTS = ("repo:started", "repo:completed", "repo:failed", "file:skipped", "file:failed", "batch:committed", "edges:resolved")


class Progress:
    """Collects the events of a run and appends them in one write."""

    def __init__(self, spark: SparkSession, tables: Tables, repo_id: str):
        self.spark, self.tables, self.repo_id = spark, tables, repo_id
        self._rows: list[tuple] = []

    def report(self, event: str, **details: object) -> None:
        if event not in EVENTS:
            raise ValueError(f"{event!r} is no progress event")
        now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        self._rows.append((self.repo_id, event, now, {k: str(v) for k, v in details.items()}))

    def flush(self) -> None:
        if self._rows:
            self.tables.append("progress", self.spark.createDataFrame(self._rows, PROGRESS).coalesce(1))
            self._rows = []


def latest(tables: Tables) -> DataFrame:
    """The last event of each repository."""
    rows = tables.read("progress", PROGRESS)
    return rows.groupBy("repo_id").agg(F.max_by("event", "at").alias("event"), F.max("at").alias("at"))
