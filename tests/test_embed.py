from codeloom import schemas
from codeloom.api import Engine
from codeloom.functions.embed import embed_rows


def _picky():
    class Picky:
        model, dim = "picky", 2

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("a text is refused")
            return [[1.0, float(len(t))] if t else None for t in texts]

    return Picky()


def test_a_text_that_fails_loses_only_its_own_row(spark):
    rows = spark.createDataFrame([(k, "bad" if k == 7 else "" if k == 8 else f"text {k}") for k in range(20)], "k int, t string").coalesce(1)
    assert sorted(r["k"] for r in embed_rows(rows, "t", _picky()).collect()) == [k for k in range(20) if k not in (7, 8)]
    flagged = {r["k"]: (r["gone"], r["vector"]) for r in embed_rows(rows, "t", _picky(), failed="gone").collect()}
    assert flagged[7] == (True, None) and 8 not in flagged and flagged[9] == (False, [1.0, 6.0])


def test_index_reports_texts_without_a_vector(spark, tmp_path):
    root = tmp_path / "checkout"
    root.mkdir()
    (root / "a.py").write_text("def good():\n    return 1\n\n\ndef bad():\n    return 2\n")
    (root / "b.py").write_text("def fine():\n    return 3\n")
    engine = Engine(spark, str(tmp_path / "db"), _picky())
    repo = engine.add_repo("https://h/x/demo.git")
    result = engine.index(repo, str(root), head="c1")
    assert (result.embeddings_stored, result.embeddings_failed, result.failed_files) == (2, 1, [("a.py", "embedding")])
    stored = engine.tables.read("embeddings", schemas.EMBEDDINGS).collect()
    assert {r["symbol_name"] for r in stored} == {"good", "fine"}
    events = engine.tables.read("progress", "repo_id string, event string, at timestamp, details map<string,string>").where("event = 'file:failed'").collect()
    assert [r["details"]["path"] for r in events] == ["a.py"]
