"""Queries that read whole texts and whole tables, by brute force."""

import os

import pytest
from conftest import DATA

from codeloom.parsing.extract import parse_files
from codeloom.plans import bundles, symbols
from codeloom.session import table

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _starts(lines, index):
    result, at, blanks = index, index - 1, 0
    while index > 0 and at >= 0:
        text = lines[at].strip()
        blanks = 0 if text else blanks + 1
        if text and not text.startswith(("//", "#", "*", '"""', "'''", "/*")) or blanks >= 2:
            break
        result = at if text else result
        at -= 1
    return max(result, 0)


def test_comments_above_declarations_are_found_in_the_whole_text(spark):
    latest = {}
    for r in table(spark, DATA, "source_files").collect():
        key, value = (r["repo_id"], r["relative_path"]), (r["walked_at"], r["content"])
        latest[key] = max(latest.get(key, value), value, key=lambda v: (v[0] is not None, v[0], v[1] or ""))
    files = spark.createDataFrame([(*key, content) for key, (_, content) in latest.items()], "repo_id string, relative_path string, content string")
    wanted = set()
    for r in parse_files(files).where("kind IN ('function', 'class')").collect():
        lines = latest[r["repo_id"], r["file_path"]][1].replace("\r\n", "\n").replace("\r", "\n").split("\n")
        wanted.add((r["repo_id"], r["file_path"], r["start_line"] - 1, _starts(lines, r["start_line"] - 1)))
    found = [tuple(r) for r in symbols.leading_comment_declared(spark, DATA).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert any(line > 9 and starts < line for _, _, line, starts in found)  # behind the tenth line
    assert "leading_comment_declared" in symbols.QUERIES


def test_chunks_of_all_kinds_are_formatted(spark):
    chunks = table(spark, DATA, "chunks")
    found = {r["chunk_id"] for r in bundles.QUERIES["bundle_markdown"](spark, DATA).where("markdown IS NOT NULL").collect()}
    assert found == {r["chunk_id"] for r in chunks.where("source_text IS NOT NULL").select("chunk_id").collect()}
    assert {r["k"] for r in chunks.where(chunks["chunk_id"].isin(*found)).selectExpr("lower(trim(symbol_type)) AS k").distinct().collect()} > {"class"}
