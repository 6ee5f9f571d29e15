import os
import random

import pytest

from codeloom.llm import pieces as P


def _text(rng, lines):
    out = []
    for _ in range(lines):
        kind = rng.random()
        if kind < 0.15:
            out.append("")
        elif kind < 0.2:
            out.append("long " * rng.randint(200, 900))
        elif kind < 0.22:
            out.append("x" * rng.randint(1000, 9000))
        else:
            out.append(" " * rng.choice([0, 2, 4]) + rng.choice(["a = b", "}", "def f():", "été 日本"]) * rng.randint(1, 6))
    return rng.choice(["\n", "\r\n"]).join(out) + rng.choice(["", "\n"])


def _check(text, rows, limit_lines=150, limit_chars=8000):
    rows = sorted(rows, key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in rows] == list(range(len(rows)))
    assert rows[0]["char_start"] == 0 and rows[-1]["char_end"] == len(text)
    for r in rows:
        assert r["piece"] == text[r["char_start"] : r["char_end"]]
        assert len(r["piece"]) <= limit_chars and r["piece"].count("\n") + 1 <= limit_lines
        assert r["first_line"] == text[: r["char_start"]].count("\n") + 1
    for a, b in zip(rows, rows[1:], strict=False):
        assert b["char_start"] <= a["char_end"] < b["char_end"]
        shared = text[b["char_start"] : a["char_end"]]
        assert shared.count("\n") + (bool(shared) and not shared.endswith("\n")) == b["shared_lines"] <= 20
        if shared:
            assert b["char_start"] == 0 or text[b["char_start"] - 1] == "\n"


@pytest.mark.parametrize("range_chars", [700, 5_000, 100_000])
def test_pieces_cover_the_text_within_the_limits(spark, range_chars):
    rng = random.Random(range_chars)
    texts = {i: _text(rng, rng.choice([3, 60, 149, 150, 151, 400, 1500])) for i in range(14)}
    texts |= {90: "y" * 30_000, 91: "\n" * 400, 92: "w " * 9000, 93: ("a" * 60 + "\n") * 700}
    frame = spark.createDataFrame([(k, t, 5) for k, t in texts.items()], "id int, t string, at int")
    out = P.split_cells(frame, "id", "t", "at", range_chars=range_chars).collect()
    big = {k for k, t in texts.items() if len(t) > 8000 or t.count("\n") + 1 > 150}
    assert {r["id"] for r in out} == big
    for k in big:
        mine = [r for r in out if r["id"] == k]
        assert len(mine) > 1
        _check(texts[k], mine)
        assert all(r["start_line"] == r["first_line"] + 4 for r in mine)


def test_cuts_prefer_blank_lines_and_share_twenty_lines(spark):
    block = "def f():\n" + "    x = 1\n" * 8 + "\n"
    text = block * 30
    out = sorted(P.split_cells(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect(), key=lambda r: r["piece_no"])
    for r in out[:-1]:
        assert text[: r["char_end"]].endswith("\n\n")
    assert all(r["shared_lines"] == 20 for r in out[1:]) and all(r["start_line"] is None for r in out)


def test_odd_rows(spark):
    kind = "id int, t string, at int, piece string, item string"
    big = "z\n" * 200
    rows = [(1, None, 1, "p", None), (2, "", 1, None, None), (3, "small", None, None, None), (4, big, None, None, None), (4, big, None, None, None), (None, big, 7, None, None), (5, big, 1, None, None), (5, big + "end", 1, None, None)]
    out = P.split_cells(spark.createDataFrame(rows, kind), "id", "t", "at").collect()
    assert {r["id"] for r in out} == {4, None, 5}
    assert len([r for r in out if r["id"] == 4 and r["piece_no"] == 0]) == 1
    assert len([r for r in out if r["id"] == 5 and r["piece_no"] == 0]) == 2
    assert P.split_cells(spark.createDataFrame([], kind), "id", "t", "at").count() == 0


def test_files_are_cut_by_byte_ranges(spark, tmp_path):
    rng = random.Random(8)
    files, texts = [], {}
    for k in range(3):
        path = str(tmp_path / f"f{k}.txt")
        texts[path] = _text(rng, 900) if k else "日本語" * 9000
        data = texts[path].encode()
        with open(path, "wb") as f:
            f.write(data)
        files.append((path, os.path.getsize(path)))
    for path, size in files:
        data = texts[path].encode()
        rows = sorted(P.split_files(spark, [(path, size)], range_bytes=10_000).collect(), key=lambda r: r["piece_no"])
        assert rows[0]["start"] == 0 and rows[-1]["end"] == size
        for r in rows:
            raw = data[r["start"] : r["end"]]
            assert r["piece"] == raw.decode() and len(raw) <= 8_003 and raw.count(b"\n") + 1 <= 150
        for a, b in zip(rows, rows[1:], strict=False):
            assert b["start"] <= a["end"] < b["end"]
    empty = str(tmp_path / "empty")
    open(empty, "w").close()
    assert P.split_files(spark, [(empty, 0)]).count() <= 1


def test_only_line_feeds_end_lines():
    text = "a\u2028b\x85c\x1dd\r\x0be\nf\n"
    assert P._stretches(text, 1000) == [(text.index("\n") + 1, True), (len(text), True)]
    assert P._stretches("", 10) == [] and P._stretches("\n\nx", 10) == [(1, True), (2, True), (3, False)]
