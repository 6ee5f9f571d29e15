import os
import subprocess

import pytest

from codeloom import schemas
from codeloom.api import Engine, ModelMismatch, UnknownRepo
from codeloom.functions.embed import HashingEmbedder
from codeloom.sources import git as source
from codeloom.sources.progress import latest


def _write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _tables(engine, repo):
    out = {}
    for name in ("functions", "classes", "imports", "call_edges", "call_sites", "embeddings", "contains", "has_method"):
        frame = engine.tables.read(name, getattr(schemas, name.upper())).where(f"repo_id = '{repo}'")
        out[name] = sorted(repr(sorted(r.asDict().items(), key=str)) for r in frame.collect())
    return out


@pytest.fixture()
def checkout(tmp_path):
    root = str(tmp_path / "checkout")
    _write(root, "src/config.py", "# Reads the settings file.\ndef load_settings(path):\n    return parse_lines(path)\n")
    _write(root, "src/parse.py", "class Reader:\n    def read_line(self):\n        return load_settings('x')\n\n\ndef parse_lines(text):\n    return text.split()\n")
    _write(root, "web/app.ts", "export function render(x: number) { return draw(x); }\nfunction draw(x: number) { return x; }\n")
    return root


def test_index_search_lookup_and_bundle(spark, tmp_path, checkout):
    engine = Engine(spark, str(tmp_path / "db"))
    repo = engine.add_repo("https://h/x/demo.git")
    result = engine.index(repo, checkout, head="c1")
    assert (result.mode, result.files_processed, result.failed_files) == ("full", 3, [])
    assert result.symbols_extracted == 6 and result.embeddings_stored == 6
    assert [r["name"] for r in engine.list_repos().collect()] == ["demo"]

    methods = engine.tables.read("has_method", schemas.HAS_METHOD).collect()
    assert [(r["file_path"], r["class_name"], r["method"]) for r in methods] == [("src/parse.py", "Reader", "read_line")]
    held = {(r["kind"], r["name"]) for r in engine.tables.read("contains", schemas.CONTAINS).where("file_path = 'src/parse.py'").collect()}
    assert held == {("class", "Reader"), ("function", "read_line"), ("function", "parse_lines")}
    assert engine.health() and engine.stats()["contains"] == 6

    hits = engine.search("load settings path", min_score=0.1, k=3).collect()
    assert hits[0]["symbol_name"] == "load_settings"
    assert engine.search("load settings", language="typescript", min_score=-1.0).count() == 2
    assert engine.search("load settings", symbol_type="type", min_score=-1.0).count() == 0
    assert engine.search("load settings", repo_id="unknown").count() == 0
    assert engine.search("   ").count() == 0
    with pytest.raises(ValueError):
        engine.search("x", symbol_type="import")
    with pytest.raises(UnknownRepo, match="demo"):
        engine.search("x", repo_name="nope")

    with pytest.raises(ModelMismatch):
        Engine(spark, str(tmp_path / "db"), HashingEmbedder(32)).search("load settings")

    found = engine.lookup("load_settings").collect()
    assert len(found) == 1 and "Reads the settings file" in found[0]["source_text"]
    assert [c["name"] for c in found[0]["callees"]] == ["parse_lines"] and len(found[0]["callers"]) == 1
    assert sorted(r["name"] for r in engine.lookup("re").collect()) == ["read_line", "render"]  # no exact hit, so by prefix
    assert [r["name"] for r in engine.lookup("Reader").collect()] == ["Reader"]
    text = engine.bundle("load settings path", max_tokens=60)
    assert "load_settings" in text and "## Related Code" in text
    assert engine.stats()["functions"] == 5

    assert engine.index(repo, checkout, mode="incremental", head="c1").mode == "none"
    engine.remove_repo(repo, purge=True)
    assert engine.stats()["functions"] == 0 and engine.list_repos().count() == 0


def test_an_incremental_run_equals_a_full_one(spark, tmp_path, checkout):
    engine = Engine(spark, str(tmp_path / "db"))
    repo = engine.add_repo("https://h/x/demo.git")
    engine.index(repo, checkout, head="c1")
    _write(checkout, "src/parse.py", "def parse_lines(text):\n    return clean(text)\n\n\ndef clean(text):\n    return load_settings(text)\n")
    os.rename(os.path.join(checkout, "web/app.ts"), os.path.join(checkout, "web/main.ts"))
    delta = spark.createDataFrame([("M", "src/parse.py", None), ("R", "web/main.ts", "web/app.ts"), ("A", "README.md", None)], "status string, path string, old_path string")
    result = engine.index(repo, checkout, mode="incremental", head="c2", changed=delta)
    assert (result.mode, result.files_processed, result.files_deleted) == ("incremental", 2, 1)
    partial = _tables(engine, repo)
    engine.index(repo, checkout, head="c2")
    assert _tables(engine, repo) == partial


def test_resume_skips_what_is_done(spark, tmp_path, checkout):
    engine = Engine(spark, str(tmp_path / "db"))
    repo = engine.add_repo("https://h/x/demo.git")
    engine.mark_processed(repo, ["src/config.py"])
    engine.mark_processed(repo, ["src/parse.py"])
    assert engine.checkpoint(repo).processed_files == ["src/config.py", "src/parse.py"]
    result = engine.index(repo, checkout, mode="resume", head="c1")
    assert result.files_processed == 1
    state = engine.checkpoint(repo)
    assert state.processed_files is None and state.last_commit == "c1"


def test_batches_are_committed_one_by_one_and_equal_one_plan(spark, tmp_path, checkout):
    one, two = Engine(spark, str(tmp_path / "a")), Engine(spark, str(tmp_path / "b"))
    one.index("r", checkout, head="c1")
    result = two.index("r", checkout, head="c1", batch_files=2)
    assert result.files_processed == 3 and result.symbols_extracted == 6
    assert _tables(one, "r") == _tables(two, "r")
    events = [r["event"] for r in two.tables.read("progress", schemas.PROGRESS).orderBy("at").collect()]
    assert events.count("batch:committed") == 2 and events[0] == "repo:started" and events[-1] == "repo:completed"
    assert latest(two.tables).first()["event"] == "repo:completed" and two.health()


def test_a_failed_run_is_reported_and_resumed(spark, tmp_path, checkout, monkeypatch):
    engine = Engine(spark, str(tmp_path / "db"))
    real, calls = engine._index_files, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(engine, "_index_files", failing)
    with pytest.raises(RuntimeError):
        engine.index("r", checkout, batch_files=2)
    assert len(engine.checkpoint("r").processed_files) == 2 and latest(engine.tables).first()["event"] == "repo:failed"
    monkeypatch.setattr(engine, "_index_files", real)
    assert engine.index("r", checkout, mode="resume", head="c1").files_processed == 1
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.index("r", checkout, head="c1")
    assert _tables(engine, "r") == _tables(whole, "r")


def test_git_checkouts(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.test", *args], cwd=origin, check=True, capture_output=True)

    origin = str(tmp_path / "origin")
    _write(origin, "a.py", "def a(): pass\n")
    git("init", "-b", "main")
    git("add", ".")
    git("commit", "-m", "one")
    folder = source.clone(origin, "main", str(tmp_path / "x" / "clone"))
    first = source.head(folder)
    _write(origin, "b.py", "def b(): pass\n")
    git("mv", "a.py", "c.py")
    git("add", ".")
    git("commit", "-m", "two")
    source.pull(folder)
    got = sorted(tuple(r) for r in source.changed_since(spark, folder, first).collect())
    assert got == [("A", "b.py", None), ("R", "c.py", "a.py")] and source.head(folder) != first
    hook = source.install_hook(folder, "http://localhost:4444/repos/r/index?incremental=1")
    assert os.access(hook, os.X_OK) and open(hook).read().startswith("#!/bin/sh")
    assert source.clone(origin, "main", folder) == folder
