"""Storage of the engine's tables as parquet partitioned by repository.

Partitions are replaced as a whole; a table is never read and overwritten by one plan: what is
written is first materialised beside the table, then moved in by dynamic partition overwrite.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION = "repo_id"


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def names(self) -> list[str]:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory() and not s.getPath().getName().startswith("_"))

    def read(self, name: str, schema: str) -> DataFrame:
        """The table, or an empty one of that schema if it does not exist."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        columns = self.spark.createDataFrame([], schema).columns
        return self.spark.read.schema(schema).parquet(self.path(name)).select(*columns)

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Creates or replaces the whole table."""
        self._swap(name, rows)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy(PARTITION).parquet(self.path(name))

    def replace_partitions(self, name: str, rows: DataFrame) -> None:
        """Replaces the partitions of the repositories that occur in ``rows``; others stay."""
        staged = self._stage(name, rows)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(self.path(name))
        self._drop_staged(name)

    def delete_where(self, name: str, schema: str, condition: Column) -> None:
        """Deletes rows for which the condition is true; null is not true."""
        if self.exists(name):
            rows = self.read(name, schema)
            touched = rows.where(condition).select(PARTITION).distinct()
            kept = rows.join(touched, PARTITION, "left_semi").where(~F.coalesce(condition, F.lit(False)))
            gone = [r[0] for r in touched.join(kept.select(PARTITION).distinct(), PARTITION, "left_anti").collect()]
            self.replace_partitions(name, kept)
            for repo in gone:
                self.drop_partition(name, repo)

    def drop_partition(self, name: str, repo_id: str) -> None:
        """Deletes a repository's rows without reading them."""
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo_id)
        self._fs.delete(self._path(f"{self.path(name)}/{PARTITION}={escaped}"), True)

    def _stage(self, name: str, rows: DataFrame) -> DataFrame:
        staged = f"{self.root}/_staged/{name}-{uuid.uuid4().hex}"
        rows.write.mode("overwrite").parquet(staged)
        self._staged = staged
        return self.spark.read.schema(rows.schema).parquet(staged)

    def _drop_staged(self, name: str) -> None:
        self._fs.delete(self._path(self._staged), True)

    def _swap(self, name: str, rows: DataFrame) -> None:
        fresh = f"{self.root}/_staged/{name}-{uuid.uuid4().hex}"
        rows.write.mode("overwrite").partitionBy(PARTITION).parquet(fresh)
        target = self._path(self.path(name))
        if self._fs.exists(target):
            self._fs.delete(target, True)
        if not self._fs.rename(self._path(fresh), target):
            raise OSError(f"{fresh} could not be moved to {target}")
