import pytest

from codeloom.llm import docpairs as D

REAL = "Walks the queue from the tail and drops what is left over."
CASES = [
    (f"// {REAL}\nfunction walk(q) {{}}", "a.js", True),
    (f"/**\n * {REAL}\n * @param q the queue\n */\nexport const walk = async (q) => {{}};", "a.ts", True),
    (f"/*! \\brief {REAL} */\nint walk(Queue q) {{ return 1; }}", "a.cpp", True),
    (f"  /// {REAL}\n\n  #[inline]\n  pub fn walk(&self, q: &Q) -> u8 {{ 1 }}", "a.rs", True),
    (f"// {REAL}\n//nolint:dupl\nfunc (r *T) Walk(q []byte) error {{ return nil }}", "a.go", True),
    (f"// TODO: make this faster\n// {REAL}\nfunction walk(q) {{}}", "a.js", True),
    (f'def walk(q):\n    """{REAL}\n\n    :param q: queue\n    """\n', "a.py", True),
    (f"# {REAL}\ndef walk(q):\n    pass\n", "a.py", True),
    (f"@cached\ndef walk(q): # noqa\n\n    r'''{REAL}'''\n", "a.PY", True),
    ("// 期限切れの項目を取り除き、残りを古い順に並べて返します。\nfunction walk(q) {}", "a.js", True),
    ("// Возвращает очередь после проверки всех записей.\nfunction walk(q) {}", "a.js", True),
    (f"// {REAL}\n\n\nfunction walk(q) {{}}", "a.js", False),  # two blank lines between
    (f"function walk(q) {{\n  // {REAL}\n}}", "a.js", False),
    (f"def walk(q):\n    x = 1\n    '''{REAL}'''\n", "a.py", False),
    ("// Walk queue for the given tail.\nfunction walkQueue(tail) {}", "a.js", False),
    ("// The walk queue function.\nfunction walkQueue(tail) {}", "a.js", False),
    ("// walkQueue - walk queue\nfunction walkQueue(tail) {}", "a.js", False),
    ("// Not documented yet.\nfunction walk(q) {}", "a.js", False),
    ("// TODO: document this function properly before the next release\nfunction walk(q) {}", "a.js", False),
    ("// FIXME missing documentation, somebody please\n// fill this in\nfunction walk(q) {}", "a.js", False),
    ("/**\n * @param q\n * @returns\n */\nfunction walk(q) {}", "a.js", False),
    ("// ============ helpers ============\nfunction walk(q) {}", "a.js", False),
    ("// Copyright (c) the Walk contributors. All rights reserved.\n// Licensed under the terms in the LICENSE file at the root.\nfunction walk(q) {}", "a.js", False),
    ("// SPDX-License-Identifier: LicenseRef-x\nfunction walk(q) {}", "a.js", False),
    ("// eslint-disable-next-line complexity, max-lines-per-function\nfunction walk(q) {}", "a.js", False),
    ('// for (const x of y.z) {\n//   x.push(y, "some words in a string");\n// }\nfunction walk(q) {}', "a.js", False),
    ("// defer a.b()\n// defer c.d()\nfunc walk() {}", "a.go", False),
    ("// (c) walk makers, distributed under a\n// permissive licence without any warranty.\nfunction walk(q) {}", "a.js", False),
    ('def walk(q):\n    """"""\n', "a.py", False),
    ("// 短い。\nfunction walk(q) {}", "a.js", False),
    ("", "a.js", False),
    ("not a function at all", "a.js", False),
]


@pytest.mark.parametrize("text,path,wanted", CASES)
def test_descriptions(text, path, wanted):
    for form in (text, text.replace("\n", "\r\n")):
        assert (D.pair(form, path, None, None) is not None) is wanted


def test_offsets_are_those_of_the_source():
    text = f"// {REAL}\nfunction walk(q) {{}}"
    told, start, end, code = D.pair(text, None, "JavaScript", "walk")
    assert told == REAL and text[start:end].strip() == f"// {REAL}" and text[code:].strip().startswith("function walk")
    assert D.pair(None, "a.js", None, None) is None and D.pair(text, "a.md", None, None) is None


def test_each_rule_is_tried_once_per_place():
    count = 0

    def probe(text, at, memo):
        nonlocal count
        count += 1
        return (at + 1, ()) if text[at : at + 1] == "a" else None

    step = D.rule("step", probe)
    both = D.first(D.seq(step, D.token("x")), D.seq(step, D.token("y")))
    assert both("ay", 0, {})[0] == 2 and count == 1


def test_long_and_nested_headers_end():
    deep = "// " + REAL + "\nfunction f(" + "(" * 300 + ")" * 300 + ") {}"
    assert D.pair(deep, "a.js", None, None) is not None
    D.pair("// " + "word " * 200_000 + "\nfunction f() {}", "a.js", None, None)
    D.pair("/* never closed " * 1000, "a.rs", None, None)


def test_tables(spark):
    kind = "chunk_id long, source_text string, file_path string, language string, symbol_name string, symbol_type string, doc_ string"
    good = f"// {REAL}\nfunction walk(q) {{}}"
    rows = [(1, good, "a.js", None, None, " Function ", None), (1, good, "a.js", None, None, " Function ", None), (2, good, "a.js", None, "walk", "class", None), (3, None, None, None, None, "function", None), (4, good, None, None, None, None, None)]
    out = D.pairs(spark.createDataFrame(rows, kind)).collect()
    assert [r["chunk_id"] for r in out] == [1, 1] and out[0]["code"].startswith("function")
    assert D.pairs(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize(
    "path,text",
    [
        ("a.cpp", "// Splits the ledger into parts of equal weight.\n" + "static inline constexpr const volatile unsigned long long int " * 3 + "foo(int a) {\n}"),
        ("a.cpp", "/** Splits the ledger into parts of equal weight. */\ntemplate <typename T,\n  typename U>\nstd::map<int, std::vector<T>> ns::Foo<T>::bar(int a) {}"),
        ("a.rs", "/// Splits the ledger into parts of equal weight.\nfn f<F: Fn(i32) -> i32>(g: F) {}"),
        ("a.rs", "/// Splits the ledger into parts of equal weight.\n#[derive(\n  A,\n  B\n)]\nfn f(a: u8) {}"),
        ("a.ts", "/** Splits the ledger into parts of equal weight. */\nfunction f<T extends { id: string }>(x: T) {}"),
        ("a.ts", "/** Splits the ledger into parts of equal weight. */\n@Dec({\n a: 1\n})\nfoo(a) {}"),
        ("a.go", "// Splits the ledger into parts of equal weight.\nfunc F[K comparable, V []int](x K) {}"),
    ],
)
def test_long_headers_nested_generics_and_attributes_over_lines(path, text):
    assert D.pair(text, path, None, None)[0] == "Splits the ledger into parts of equal weight."


def test_methods_are_paired_too(spark):
    kind = "chunk_id long, symbol_name string, symbol_type string, file_path string, language string, source_text string"
    body = "// Splits the ledger into parts of equal weight.\nfoo(a) {}\n"
    rows = [(1, "foo", "function", "a.js", None, body), (2, "foo", " Method ", "a.js", None, body), (3, "foo", "class", "a.js", None, body)]
    assert sorted(r["chunk_id"] for r in D.pairs(spark.createDataFrame(rows, kind)).collect()) == [1, 2]
