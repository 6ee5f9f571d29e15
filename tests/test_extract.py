import pytest

from codeloom.parsing import lexer
from codeloom.parsing.extract import extract, parse_files


def _names(text, language, kind, **kw):
    return [(s.class_name + "." if s.class_name else "") + s.name for s in extract(text, language, **kw) if s.kind == kind]


TS = """import def, { a as b, c } from './m';
import * as ns from "n";
import 'side';
export interface Shape<T> { area(): number }
type Id = string | { x: number };
export async function outer(x: number): Promise<Id> {
  function inner() { return helper(`${x} ( {`); }
  return inner();
}
const arrow = async (a: Shape<string>): Promise<void> => { this.go(a); };
class Box extends Base {
  field = 1;
  constructor(private x: number) { super(x); }
  static async run(): Promise<void> { await outer(1); }
  get value(): number { return this.x / 2 / 3; }
}
"""


def test_typescript():
    assert _names(TS, "typescript", "function") == ["outer", "inner", "arrow", "Box.constructor", "Box.run", "Box.value"]
    assert _names(TS, "typescript", "class") == ["Box"]
    assert _names(TS, "typescript", "type") == ["Shape", "Id"]
    imports = [(s.module_path, s.symbols) for s in extract(TS, "typescript") if s.kind == "import"]
    assert imports == [("./m", ("def", "a", "c")), ("n", ("*",)), ("side", ())]
    calls = {(s.name, s.caller_name) for s in extract(TS, "typescript") if s.kind == "call"}
    assert {("inner", "outer"), ("go", "arrow"), ("outer", "run")} <= calls
    lines = {s.name: (s.start_line, s.end_line) for s in extract(TS, "typescript") if s.kind in ("function", "class")}
    assert lines["outer"] == (6, 9) and lines["Box"] == (11, 16)


def test_javascript_has_no_types():
    text = "class A { m() { return /[{(\"']/.test(x); } }\nconst f = x => x + 1;\nconst g = 5;\n"
    assert _names(text, "javascript", "function") == ["f", "A.m"] and _names(text, "javascript", "type") == []


def test_tsx_text_with_quotes():
    text = "export function V() {\n  return (<li id={a.b}>{a.map((it) => <span key={it.id}>it's here</span>)}</li>);\n}\nfunction W() {}\n"
    assert _names(text, "tsx", "function") == ["V", "W"]


PY = """import os, sys as system
from . import sibling
from .pkg import one, two as deux

@wraps
def decorated():
    called(1)

async def plain():
    def nested(): pass
    obj.method()

class A:
    def m(self): pass
    @property
    def p(self): return 1
    class B:
        def n(self): pass
"""


def test_python():
    assert _names(PY, "python", "function") == ["decorated", "plain", "A.m", "A.p", "B.n"]
    assert _names(PY, "python", "class") == ["A", "B"]
    imports = [(s.module_path, s.symbols) for s in extract(PY, "python") if s.kind == "import"]
    assert imports == [("os", ("os",)), ("sys", ("sys",)), (".", ("sibling",)), (".pkg", ("one", "two"))]
    assert {(s.name, s.caller_name) for s in extract(PY, "python") if s.kind == "call"} == {("called", "decorated"), ("method", "plain")}
    assert "decorated" not in _names(PY, "python", "function", compat=True)
    assert _names(PY, "python", "call", compat=True) == []
    assert extract("def broken(:\n", "python") == []


GO = """package main
import "fmt"
import (
    al "a/b"
    . "c"
)
type T struct { x int }
type I interface { M() }
type N int
func free(a map[string]interface{}) (r int, err error) {
    go func() { bare(1) }()
    fmt.Println(`}`)
    return 1, nil
}
func (t *T) Method(x []byte) {}
func (T) Value() {}
"""


def test_go():
    assert _names(GO, "go", "function") == ["free", "T.Method", "T.Value"]
    assert _names(GO, "go", "class") == ["T"] and _names(GO, "go", "type") == ["I"]
    assert [(s.module_path, s.symbols) for s in extract(GO, "go") if s.kind == "import"] == [("fmt", ()), ("a/b", ("al",)), ("c", (".",))]
    assert "bare" in _names(GO, "go", "call") and "Println" not in _names(GO, "go", "call")


RUST = """use std::{fmt, io::Read};
/* outer /* nested } */ still */
pub struct P { x: u8 }
struct U(u8);
enum E { A }
type Alias = Vec<u8>;
impl<'a> Trait<u8> for P { fn m(&self) -> &'a str { helper('{'); "}" } }
impl P { pub fn new() -> Self { P { x: 1 } } }
pub(crate) async fn free<T: Into<u8>>(x: T) -> u8 { fn inner() {} 1 }
mod deep { pub fn in_mod() {} }
trait Tr { fn provided(&self) {} fn needed(&self); }
"""


def test_rust():
    assert _names(RUST, "rust", "function") == ["P.m", "P.new", "free", "in_mod", "provided"]
    assert _names(RUST, "rust", "class") == ["P", "U"] and _names(RUST, "rust", "type") == ["Alias"]
    assert [s.module_path for s in extract(RUST, "rust") if s.kind == "import"] == ["std::{fmt, io::Read}"]
    assert "helper" in _names(RUST, "rust", "call")


CPP = """#include <vector>
#include "a/b.h"
namespace n {
class C : public D {
public:
  C(int x) : D(x) {}
  ~C() {}
  int get() const { return call(1'000); }
  void declared();
};
}
void n::C::declared() { obj.member(); }
static int free(std::string s, const char* t = "(") { return 1; }
struct S { int y; };
"""


def test_cpp():
    assert _names(CPP, "cpp", "function") == ["C.C", "C.C", "C.get", "declared", "free"]
    assert _names(CPP, "cpp", "class") == ["C", "S"]
    assert [s.module_path for s in extract(CPP, "cpp") if s.kind == "import"] == ["vector", "a/b.h"]
    assert "get" not in [s.name for s in extract(CPP, "cpp", compat=True) if s.kind == "function"]
    assert "call" in _names(CPP, "cpp", "call") and "member" not in _names(CPP, "cpp", "call")


@pytest.mark.parametrize("language", ["typescript", "tsx", "javascript", "go", "rust", "cpp", "python"])
def test_tokens_keep_the_text_and_odd_input_is_survived(language):
    for text in (TS, PY, GO, RUST, CPP, "", "\\", "'", '"', "`${", "/*", "{{{", ")))", "é ", "﻿x"):
        assert "".join(lexer.tokens(text, language)) == text
        extract(text, language)
    assert extract(None, language) == [] and extract("x", None) == []


def test_files_are_parsed_in_one_pass(spark):
    rows = [("r", "a.go", GO), ("r", "b.md", "x"), ("r", "c.py", None), ("r", "d.py", "")]
    out = parse_files(spark.createDataFrame(rows, "repo_id string, relative_path string, content string")).collect()
    assert {r["file_path"] for r in out} == {"a.go"} and [r["ordinal"] for r in out] == list(range(len(out)))


DAMAGED = '''import os
from .pkg import one

def before():
    return helper(1)

class Box:
    @wraps(os)
    def whole(self):
        return """
def in_a_text(): pass
"""
    def broken(self):
        kept(1)
        x = call(1, [2
        return other()

    def also_whole(self):
<<<<<<< ours
        return a(1)
=======
        return b(1)
>>>>>>> theirs

    def last(self): pass

if one:
    c(1)
elif two(]:
    d(2)
else:
    e(3)

@wraps
async def after():
    from os import path
    return g()

def cut(
'''


def test_damaged_python_gives_what_is_intact():
    assert _names(DAMAGED, "python", "function") == ["before", "Box.whole", "Box.last", "after"]
    assert _names(DAMAGED, "python", "class") == []  # as in the reference, a definition with an error in it is left out
    assert [s.module_path for s in extract(DAMAGED, "python") if s.kind == "import"] == ["os", ".pkg", "os"]
    calls = {(s.name, s.caller_name) for s in extract(DAMAGED, "python") if s.kind == "call"}
    assert calls == {("helper", "before"), ("wraps", "whole"), ("kept", "broken"), ("other", "broken"), ("a", "also_whole"), ("b", "also_whole"), ("c", ""), ("d", ""), ("e", ""), ("g", "after")}
    lines = {s.name: (s.start_line, s.end_line, s.signature) for s in extract(DAMAGED, "python") if s.kind == "function"}
    assert lines["whole"][:2] == (8, 12) and lines["whole"][2].startswith("def whole(self)")
    assert lines["after"][:2] == (34, 37)
    assert _names(DAMAGED, "python", "function", compat=True) == ["before", "Box.last"]


def test_unreadable_text_ends_no_class():
    text = "class A:\n    def m(self):\n        x()\nlost merge text\n        y()\n    def n(self): pass\ndef f(): pass\n"
    assert _names(text, "python", "function") == ["A.n", "f"]
    assert _names("import os\n    import sys\n", "python", "import") == ["os", "sys"]


@pytest.mark.parametrize("deep", ["+".join(["f(x)"] * 20_000), "(" * 300 + "f(x)" + ")" * 300])
def test_python_too_deep_for_its_parser_keeps_its_definitions(deep):
    text = f"import os\ndef a():\n    return g({deep})\n\nclass C:\n    def b(self): pass\n"
    assert _names(text, "python", "function") == ["a", "C.b"] and _names(text, "python", "class") == ["C"]
    assert [(s.start_line, s.end_line) for s in extract(text, "python") if s.name == "a"] == [(2, 3)]
    assert {("f", "a"), ("g", "a")} <= {(s.name, s.caller_name) for s in extract(text, "python") if s.kind == "call"}


@pytest.mark.parametrize("text", ["else:\n" * 20_000, "x = (\n" * 20_000, "case\n" * 20_000 + "(", "@a\n" * 20_000, "try:\n" * 20_000, "def f(:\n" * 20_000, '"""\n' * 20_001])
def test_damaged_python_is_read_in_linear_time(text):
    import time

    start = time.process_time()
    extract(text, "python")
    assert time.process_time() - start < 10


def test_long_declarations_are_read_whole():
    many = ", ".join(f"int a{i}" for i in range(150))
    held = ", ".join(f"m{i}(a{i})" for i in range(150))
    text = f"class C {{\npublic:\n  C({many}) : {held} {{ call(1); }}\n}};\nint free({many}) noexcept {{ return other(2); }}\n"
    assert _names(text, "cpp", "function") == ["C.C", "free"]
    assert {("call", "C"), ("other", "free")} <= {(s.name, s.caller_name) for s in extract(text, "cpp") if s.kind == "call"}

    fields = "; ".join(f"f{i}: Map<string, number>" for i in range(100))
    types = ", ".join(f"T{i} extends {{ x: number }} = {{ x: 1 }}" for i in range(100))
    args = ", ".join(f"a{i}: number" for i in range(100))
    union = " | ".join(f"'u{i}'" for i in range(300))
    names = ", ".join(f"n{i}" for i in range(300))
    text = (
        f"import {{ {names} }} from './m';\n"
        f"const typed: (a: {{ {fields} }}, b: {union}) => void = (a) => {{ one(a); }};\n"
        f"const returns = ({args}): {union} => {{ two(1); }};\n"
        f"const shaped = ({args}): {{ {fields} }} => {{ three(1); }};\n"
        f"function generic<{types}>(x: number) {{ four(1); }}\n"
        f"type Alias<{types}> = number;\n"
    )
    assert _names(text, "typescript", "function") == ["generic", "typed", "returns", "shaped"] and _names(text, "typescript", "type") == ["Alias"]
    assert [len(s.symbols) for s in extract(text, "typescript") if s.kind == "import"] == [300]
    assert {("one", "typed"), ("two", "returns"), ("three", "shaped"), ("four", "generic")} <= {(s.name, s.caller_name) for s in extract(text, "typescript") if s.kind == "call"}

    bounds = ", ".join(f"T{i}: Into<u8>" for i in range(100))
    assert _names(f"fn f<{bounds}>(x: u8) {{}}\ntype A<{bounds}> = u8;\n", "rust", "function") == ["f"]


def test_a_variable_without_a_value_takes_none_from_the_next():
    assert _names("let a\nlet b: number\nconst f = (x) => x;\nconst n = (1 + 2) / 3\nlist.map(y => y);\n", "typescript", "function") == ["f"]


@pytest.mark.parametrize(("text", "language"), [("a(b) " * 30_000, "cpp"), ("type T<" * 30_000, "typescript"), ("const a: b " * 30_000, "typescript"), ("const a = (b): c " * 20_000, "typescript"), ("import a " * 30_000, "typescript"), ("fn f<;" * 30_000, "rust")])
def test_declarations_without_an_end_are_read_in_linear_time(text, language):
    import time

    start = time.process_time()
    extract(text, language)
    assert time.process_time() - start < 10
