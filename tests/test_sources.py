import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.sources import registry
from codeloom.sources.tables import Tables
from codeloom.sources.walk import filter_walk, read_files, walk_repo, walk_repos


def _write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_walk(spark, tmp_path):
    _write(
        tmp_path,
        {
            "index.ts": "1", "app.py": "", "pkg/__init__.py": "", ".github/a.js": "x", "node_modules/d.ts": "x", "a/.git/c.ts": "x", "a/vendor/b.go": "x",
            "bundle.min.js": "x", "types.d.ts": "x", "README.md": "x", "config.json": "{}", "large.ts": "y" * 60, "b/C.PY": b"\xff\xfeok",
        },
    )
    os.symlink(tmp_path / "index.ts", tmp_path / "link.ts")
    skipped = []
    rows = walk_repo(spark, str(tmp_path), "r", 50, skipped).collect()
    assert sorted((r["relative_path"], r["language"]) for r in rows) == [
        (".github/a.js", "javascript"), ("app.py", "python"), ("b/C.PY", "python"), ("index.ts", "typescript"), ("pkg/__init__.py", "python"),
    ]
    assert skipped == [("large.ts", "too-large")]
    everything = walk_repo(spark, str(tmp_path), "r")
    assert everything.count() == 6
    texts = {r["relative_path"]: r["content"] for r in read_files(everything).collect()}
    assert texts["b/C.PY"] == "��ok" and texts["app.py"] == ""
    gone = spark.createDataFrame([(str(tmp_path / "none.ts"),)], "absolute_path string")
    assert read_files(gone).first()["content"] is None
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo_id string, root string")
    assert walk_repos(spark, roots, 50).count() == 5


def test_filter_walk(spark):
    rows = [("./a/b.py", "x"), ("a/dist/b.py", "x"), ("a/x.min.js", "x"), ("a/b.md", "x"), ("a/b.go", "é" * 6), ("a/n.rs", None)]
    frame = spark.createDataFrame(rows, "relative_path string, content string")
    assert [r["relative_path"] for r in filter_walk(frame, 10).collect()] == ["./a/b.py"]


KIND = "repo_id string, name string, v int"


def test_tables(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "db"))
    assert tables.read("t", KIND).count() == 0 and not tables.exists("t") and tables.names() == []

    def frame(*rows):
        return spark.createDataFrame(list(rows), KIND)

    def rows():
        return sorted(map(tuple, tables.read("t", KIND).collect()))

    tables.overwrite("t", frame(("a", "x", 1), ("b", "y", 2)))
    tables.append("t", frame(("a", "z", 3)))
    assert rows() == [("a", "x", 1), ("a", "z", 3), ("b", "y", 2)]
    # A plan that reads the table it replaces.
    tables.replace_partitions("t", tables.read("t", KIND).where("repo_id = 'a'").withColumn("v", F.col("v") * 10))
    assert rows() == [("a", "x", 10), ("a", "z", 30), ("b", "y", 2)]
    tables.delete_where("t", KIND, (F.col("name") == "x") | (F.col("name") == "y"))
    assert rows() == [("a", "z", 30)]
    tables.delete_where("t", KIND, F.lit(None).cast("boolean"))
    tables.overwrite("t", frame(("c", "q", 1)))
    assert rows() == [("c", "q", 1)] and tables.names() == ["t"]
    tables.drop_partition("t", "c")
    assert rows() == []


def test_config(tmp_path):
    path = str(tmp_path / "config.json")
    config = registry.load_config(path)
    assert (config.max_file_size_bytes, config.embedding_concurrency, config.memory_threshold_ratio, config.embedding_max_queue) == (1_048_576, 5, 0.80, 500)
    assert registry.load_config(path) == config
    for wrong in ({"memory_threshold_ratio": 0.3}, {"embedding_concurrency": 0}, {"port": 0}, {"repos": [{"id": "x", "url": "https://h/a"}]}):
        with open(path, "w") as f:
            json.dump(wrong, f)
        with pytest.raises(registry.ConfigError):
            registry.load_config(path)
    with open(path, "w") as f:
        json.dump({"repos": [{"id": "0c0ca60c-dfeb-4cdb-adf5-18cc0a84a3e8", "url": "https://h/a/tool.git"}]}, f)
    assert registry.load_config(path).repos[0]["name"] == "tool"


def test_registry(spark):
    repos = spark.createDataFrame([], registry.REPOS)
    repos, first = registry.add(spark, repos, "https://h/x/Tool.git")
    repos, second = registry.add(spark, repos, "git@h:x/other.git", "TOOL")
    assert [r[0] for r in registry.resolve(repos, name="tool").collect()] == [first]
    assert [r[0] for r in registry.resolve(repos, repo_id="unknown").collect()] == ["unknown"]
    assert registry.resolve(repos).count() == 2 and registry.resolve(repos, name="none").count() == 0
    assert registry.remove(repos, first).count() == 1 and second
    with pytest.raises(ValueError):
        registry.add(spark, repos, "ftp://x")
