"""Registry of repositories (U13, E1, E5, F15, F16) and configuration."""

from __future__ import annotations

import datetime
import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import repo_name
from codeloom.functions.text import strip
from codeloom.operators.graph import last_wins
from codeloom.schemas import REPOS

_URL = re.compile(r"^(https?://|git@)\S+$")
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)


class ConfigError(ValueError):
    """What is wrong with a configuration, one message per field."""


@dataclass
class Config:
    port: int = 4444
    data_dir: str = "data"
    max_file_size_bytes: int = 1_048_576
    embedding_concurrency: int = 5
    memory_threshold_ratio: float = 0.80
    embedding_max_queue: int = 500
    repos: list[dict] = field(default_factory=list)

    def validate(self) -> Config:
        wrong = []
        for name, low, high in (("port", 1, 65_535), ("embedding_concurrency", 1, 20), ("memory_threshold_ratio", 0.5, 0.95)):
            value = getattr(self, name)
            if not isinstance(value, int | float) or isinstance(value, bool) or not low <= value <= high:
                wrong.append(f"{name}: {value!r} is not within {low} and {high}")
        for name in ("max_file_size_bytes", "embedding_max_queue"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) <= 0:
                wrong.append(f"{name}: {getattr(self, name)!r} is no positive number")
        for k, repo in enumerate(self.repos):
            if not _UUID.match(str(repo.get("id", ""))):
                wrong.append(f"repos[{k}].id: no UUID")
            if not _URL.match(str(repo.get("url", ""))):
                wrong.append(f"repos[{k}].url: no repository URL")
            elif not repo.get("name"):
                repo["name"] = name_of(repo["url"])
        if wrong:
            raise ConfigError("; ".join(wrong))
        return self


def load_config(path: str) -> Config:
    """Reads and checks a JSON configuration; a missing file is created with defaults."""
    if not os.path.exists(path):
        save_config(Config(), path)
        return Config()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    known = {k: v for k, v in given.items() if k in Config.__dataclass_fields__}
    return Config(**known).validate()


def save_config(config: Config, path: str) -> None:
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(asdict(config), f, indent=2)
    os.replace(draft, path)


def name_of(url: str) -> str:
    return re.sub(r"\.git$", "", url.rsplit("/", 1)[-1])


def normalised(repos: DataFrame) -> DataFrame:
    """One row per id: the last added; a missing name comes from the URL, branches are lower-cased."""
    one = last_wins(repos.where("id IS NOT NULL"), ["id"], [F.col("added_at"), F.col("url"), F.col("name"), F.col("branch")])
    named = F.when(F.coalesce(strip(F.col("name")), F.lit("")) == "", repo_name(F.col("url"))).otherwise(F.lower(strip(F.col("name"))))
    return one.select("id", named.alias("name"), "url", F.coalesce(F.lower("branch"), F.lit("main")).alias("branch"), "added_at")


def resolve(repos: DataFrame, name: str | None = None, repo_id: str | None = None) -> DataFrame:
    """Ids to search: a given id wins and is not checked; then the first repository of that name
    (case ignored, in the order of the registry); then all."""
    spark = repos.sparkSession
    if repo_id is not None:
        return spark.createDataFrame([(repo_id,)], "id string")
    if name is not None:
        return repos.where(F.lower("name") == F.lit(name.lower())).orderBy("added_at", "id").limit(1).select("id")
    return repos.select("id").distinct()


def add(spark: SparkSession, repos: DataFrame, url: str, name: str | None = None, branch: str = "main") -> tuple[DataFrame, str]:
    if not _URL.match(url):
        raise ValueError(f"{url!r} is no repository URL")
    new = str(uuid.uuid4())
    row = [(new, name or name_of(url), url, branch, datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))]
    return repos.unionByName(spark.createDataFrame(row, REPOS)), new


def remove(repos: DataFrame, repo_id: str) -> DataFrame:
    return repos.where(F.col("id") != F.lit(repo_id))
