"""Texts on which careless patterns take quadratic time; each has to end at once."""

import time

import pytest

from codeloom.llm import docpairs, nearcopies, pieces, provenance, sentences, syntax
from codeloom.parsing.extract import extract

N = 30_000
TEXTS = {
    "letters": "a" * N, "dots": "." * N, "brackets": "(" * N, "strays": "([)]" * (N // 4), "lines": "\n" * N, "comments": "//\n" * N,
    "open comments": "/* " * N, "stars": "* " * N, "blanks": " " * N, "quotes": '"' * N, "ticks": "`${" * N, "abbreviations": "e.g. " * N,
    "quoted": 'He said "it is. so" and left. ' * (N // 20), "apostrophes": "it's " * N, "copyright": "// Copyright 1.1\n" * N, "cjk": "漢" * N, "assign": "= " * N,
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_time_is_linear(name):
    text, began = TEXTS[name], time.time()
    sentences.split_text(text)
    provenance.evidence("a.js", text)
    nearcopies.shingles(text)
    pieces.boundaries(text[:16_384], "", text[16_384:16_640], 150, 8_000, 20)
    for language in ("python", "tsx", "go", "rust", "cpp"):
        syntax.repair(text, language)
        extract(text, language)
    for path in ("a.py", "a.js", "a.rs", "a.cpp", "a.go"):
        docpairs.pair(f"/*\n{text}\n*/\nfunction f() {{}}", path, None, None)
        docpairs.pair(text, path, None, None)
    assert time.time() - began < 30
