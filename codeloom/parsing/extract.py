"""Symbols of source files per language (X1-X8): functions, classes, types, imports, call sites.

Python is read by its own parser; the brace languages by the shared lexer, a bracket matcher and
declaration patterns over the token stream. Each file is read once and gives tagged rows. Files that
do not parse give what can be read of them, Python statement by statement; the extractor never fails.

Deviations from a full grammar: names, spans, enclosing class, imports and bare or member calls
are read; computed method names, macros that declare functions and conditional compilation are not
followed.
"""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import language
from codeloom.parsing import lexer

ROWS = (
    "repo_id string, file_path string, kind string, ordinal int, name string, class_name string, start_line int, end_line int, "
    "signature string, language string, module_path string, symbols array<string>, caller_name string"
)


class Symbol(NamedTuple):
    kind: str
    name: str
    start_line: int
    end_line: int
    signature: str = ""
    class_name: str = ""
    module_path: str = ""
    symbols: tuple[str, ...] = ()
    caller_name: str = ""


# --- Python -------------------------------------------------------------------------------------


#: Words that start a statement and stand in no bracket: a line that starts so ends what is open.
_STATEMENT = frozenset("def class import return while try except finally elif raise pass break continue del global nonlocal assert with".split())
#: What a clause needs above it to be read alone.
_ABOVE = {"else": "if 1: pass", "elif": "if 1: pass", "except": "try: pass", "finally": "try: pass", "case": ""}
_CONFLICT = ("<<<<<<<", "=======", ">>>>>>>", "|||||||")
_CONTINUED = re.compile(r"[^\S\n]*\\\n")
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def _parsed(text: str) -> tuple[ast.Module | None, bool]:
    """The tree, or none and whether a limit of the parser is the reason, not the text."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text), False
        except SyntaxError as error:
            return None, str(error.msg).startswith("too many")
        except ValueError:
            return None, False
        except (RecursionError, MemoryError):
            return None, True


class _PythonRows:
    """Rows of parsed statements of one text."""

    def __init__(self, text: str, compat: bool):
        self.lines, self.compat = text.split("\n"), compat
        self.out: list[Symbol] = []

    def span(self, node, end: int) -> tuple[int, int, str]:
        start = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        head = "\n".join(self.lines[node.lineno - 1 : end])[node.col_offset :][:200]
        return (node.lineno if self.compat else start), end, head

    def functions(self, body: list, owner: str, end: int | None = None) -> None:
        for node in body:
            if isinstance(node, _FUNCTION):
                if self.compat and node.decorator_list:
                    continue
                self.out.append(Symbol("function", node.name, *self.span(node, end or node.end_lineno), owner))

    def read(self, body: list, scope: str | None = "", caller: str = "") -> None:
        """Statements of the module (``scope`` is empty), of the class ``scope`` or of other blocks (none)."""
        for node in body:
            if isinstance(node, _FUNCTION) and scope is not None:
                self.functions([node], scope)
            elif isinstance(node, ast.ClassDef):
                self.functions(node.body, node.name)
        tree = ast.Module(body, [])
        direct = set(map(id, body))
        for node in ast.walk(tree):
            if isinstance(node, ast.ClassDef):
                self.out.append(Symbol("class", node.name, *self.span(node, node.end_lineno)))
                if id(node) not in direct:
                    self.functions(node.body, node.name)
            elif isinstance(node, ast.Import):
                for alias in node.names:
                    if not (self.compat and alias.asname):
                        self.out.append(Symbol("import", alias.name, node.lineno, node.end_lineno, module_path=alias.name, symbols=(alias.name,)))
            elif isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
                self.out.append(Symbol("import", module, node.lineno, node.end_lineno, module_path=module, symbols=tuple(a.name for a in node.names)))
        if not self.compat:
            self.calls(tree, caller)

    def calls(self, tree: ast.AST, caller: str) -> None:
        waiting = [(tree, caller)]
        while waiting:
            node, caller = waiting.pop()
            if isinstance(node, ast.Call):
                f = node.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    self.out.append(Symbol("call", name, node.lineno, node.end_lineno, caller_name=caller))
            if isinstance(node, _FUNCTION):
                caller = node.name
            waiting.extend((child, caller) for child in reversed(list(ast.iter_child_nodes(node))))


def _python(text: str, compat: bool) -> list[Symbol]:
    rows = _PythonRows(text, compat)
    tree, _ = _parsed(text)
    if tree is not None:
        rows.read(tree.body)
    else:
        _read_damaged(rows, text)
    return rows.out


def _logical_lines(s: _Stream) -> list[int]:
    """First tokens of the logical lines of a Python text that need not be well-formed.

    A line break ends a line where no bracket is open. Where a statement begins with brackets still
    open, these lack their ends, and they hold no line break back.
    """
    starts, breaks, opened = [0], [], []

    def settle() -> None:
        depth = 0
        for k, open_brackets in breaks:
            while depth < len(opened) and opened[depth] < k:
                depth += 1
            if open_brackets == depth:
                starts.append(k)
        breaks.clear()
        opened.clear()

    for k, token in enumerate(s.tokens):
        if k and s.line[k] > s.end_line(k - 1) and not _CONTINUED.match(s.text, s.at[k - 1] + len(s.tokens[k - 1])):
            conflict = token.startswith(_CONFLICT) and len(token) > 6
            if conflict or token in _STATEMENT or (token == "async" and s.get(k + 1) in ("def", "with")) or (token == "from" and _from_import(s, k)) or (token == "@" and _decorates(s, k)):
                settle()
                starts.append(k)
            elif token not in (")", "]", "}"):
                breaks.append((k, len(opened)))
        if token in ("(", "[", "{"):
            opened.append(k)
        elif token in (")", "]", "}") and opened and s.tokens[opened[-1]] == _OPEN[_CLOSE.index(token)]:
            opened.pop()
    settle()
    return starts if s.tokens else []


def _from_import(s: _Stream, k: int) -> bool:
    k += 1
    while s.get(k) in (".", "...", "..") or (s.is_name(k) and s.tokens[k] != "import"):
        k += 1
    return s.get(k) == "import"


def _decorates(s: _Stream, k: int) -> bool:
    """Whether the line that starts with @ is a decorator: a dotted name, its arguments and a line break."""
    k += 1
    while s.is_name(k) and s.get(k + 1) == ".":
        k += 2
    if not s.is_name(k):
        return False
    k = s.match.get(k + 1, k) if s.get(k + 1) == "(" else k
    return s.get(k + 1) in ("@", "def", "class", "async") and s.line[k + 1] > s.end_line(k)


def _read_damaged(rows: _PythonRows, text: str) -> None:
    """What can be read of a text that does not parse: every statement that parses alone.

    The logical lines form a tree by indentation. A statement that fails is left out, and the
    statements of its block are read one by one; definitions are left out with an error in them, as
    in the reference, but kept where only a limit of the parser is the reason.
    """
    s = _Stream(text, "python")
    starts = _logical_lines(s)
    count = len(starts)
    last = [*(k - 1 for k in starts[1:]), len(s.tokens) - 1]
    indent = [len(text[text.rfind("\n", 0, s.at[k]) + 1 : s.at[k]].expandtabs(8)) for k in starts]
    for n in reversed(range(count - 1)):
        marker = s.tokens[starts[n]].startswith(_CONFLICT) and len(s.tokens[starts[n]]) > 6
        if marker or (indent[n] < indent[n + 1] and s.tokens[last[n]] != ":" and _parsed(text[s.at[starts[n]] : s.at[last[n]] + len(s.tokens[last[n]])])[0] is None):
            indent[n] = indent[n + 1]  # a marker or unreadable text belongs to the block that it stands in
    behind, above = [count] * count, []  # the line behind the block of each line
    for n in range(count):
        while above and indent[above[-1]] >= indent[n]:
            behind[above.pop()] = n
        above.append(n)

    def parse(a: int, b: int, head: str = "", tail: str = "") -> tuple[list | None, bool]:
        """Statements of the lines a to b (exclusive) at their places in the text."""
        first, end = s.line[starts[a]], s.end_line(last[b - 1])
        case = s.tokens[starts[a]] == "case" and tail != ""
        wrap = ["match 1:" if case else "if 1:"] if indent[a] else []
        wrap += [re.match(r"\s*", rows.lines[first - 1])[0] + head] if head else []
        piece = "\n".join([*wrap, *rows.lines[first - 1 : end]]) + tail
        tree, limit = _parsed(piece)
        if tree is None:
            return None, limit
        ast.increment_lineno(tree, first - 1 - len(wrap))
        if case and isinstance(tree.body[0], ast.Match):
            return tree.body[0].cases, False
        return (tree.body[0].body if indent[a] else tree.body), False

    def tokens_called(n: int, caller: str) -> None:
        for k in range(starts[n] + 1, last[n] + 1):
            name = s.tokens[k - 1]
            if s.tokens[k] == "(" and s.is_name(k - 1) and not keyword.iskeyword(name) and s.get(k - 2) not in ("def", "class"):
                rows.out.append(Symbol("call", name, s.line[k - 1], s.end_line(s.match.get(k, k)), caller_name=caller))

    waiting: list[tuple[int, int, str | None, str]] = [(0, count, "", "")]
    while waiting:
        n, stop, scope, caller = waiting.pop()
        if n >= stop:
            continue
        head = n  # the line behind decorators
        while s.tokens[starts[head]] == "@" and behind[head] == head + 1 < stop and indent[head + 1] == indent[n]:
            head += 1
        end = behind[head]
        chain = end
        while chain < stop and s.tokens[starts[chain]] in _ABOVE and indent[chain] == indent[n] and s.tokens[starts[n]] not in _ABOVE:
            chain = behind[chain]
        body, limit = parse(n, chain)
        if body is not None:
            rows.read(body, scope, caller)
            waiting.append((chain, stop, scope, caller))
            continue
        waiting.append((end, stop, scope, caller))
        word = s.tokens[starts[head]]
        at = starts[head] + (word == "async")
        inner_scope, inner_caller = None, caller
        if s.get(at) in ("def", "class") and s.is_name(at + 1) and at + 1 <= last[head]:
            inner_scope, inner_caller = (None, s.tokens[at + 1]) if s.tokens[at] == "def" else (s.tokens[at + 1], caller)
        if end > head + 1 or s.tokens[last[head]] == ":":
            block = s.tokens[last[head]] == ":"
            header, _ = parse(n, head + 1, _ABOVE.get(word, "") if block else "", " pass" if block else "")
            if header and not block:  # whole in itself, with a block behind it that has no head
                rows.read(header, scope, caller)
            elif header:
                if limit and isinstance(header[-1], (*_FUNCTION, ast.ClassDef)):
                    node, close = header[-1], s.end_line(last[end - 1])
                    if isinstance(node, ast.ClassDef):
                        rows.out.append(Symbol("class", node.name, *rows.span(node, close)))
                    elif scope is not None:
                        rows.functions([node], scope, close)
                if not rows.compat:
                    for node in header:
                        rows.calls(node, caller)
        elif limit and not rows.compat:
            tokens_called(n, caller)
        waiting.append((head + 1, end, inner_scope, inner_caller))


# --- brace languages ----------------------------------------------------------------------------

_OPEN, _CLOSE = "([{", ")]}"
_IDENT = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$]*$")
_NOT_CALLED = frozenset("if for while switch catch return function func fn sizeof match typeof await super new delete throw and or not else do case decltype alignof noexcept import require_once".split())


#: Tokens that no list of types holds, and words that begin another declaration.
_NO_TYPE = frozenset("; || == === != !== return let var while if else".split())
_STARTS = frozenset("const let var function class export enum".split())


class _Stream:
    """Significant tokens of a text with lines, offsets and matching brackets."""

    def __init__(self, text: str, name: str):
        self.text = text
        family = lexer.FAMILY[name]
        self.tokens: list[str] = []
        self.at: list[int] = []
        self.line: list[int] = []
        pos, row = 0, 1
        for token in lexer.tokens(text, name):
            if not lexer.is_trivia(token, family):
                if token[0] == ">" and len(token) > 1 and family == "tsx":
                    self._add(">", pos, row)
                else:
                    self._add(token, pos, row)
            pos += len(token)
            row += token.count("\n")
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, token in enumerate(self.tokens):
            if token in _OPEN and len(token) == 1:
                stack.append(k)
            elif token in _CLOSE and len(token) == 1:
                while stack and _OPEN[_CLOSE.index(token)] != self.tokens[stack[-1]]:
                    stack.pop()
                if stack:
                    self.match[stack.pop()] = k
        self.depth_owner: list[int] = []
        open_at: list[int] = []
        for k in range(len(self.tokens)):
            while open_at and self.match.get(open_at[-1], len(self.tokens)) <= k:
                open_at.pop()
            self.depth_owner.append(open_at[-1] if open_at else -1)
            if k in self.match and self.tokens[k] == "{":
                open_at.append(k)
        self.angles: dict[int, int] | None = None

    def _add(self, token: str, pos: int, row: int) -> None:
        self.tokens.append(token)
        self.at.append(pos)
        self.line.append(row)

    def get(self, k: int) -> str:
        return self.tokens[k] if 0 <= k < len(self.tokens) else ""

    def is_name(self, k: int) -> bool:
        return bool(_IDENT.match(self.get(k)))

    def end_line(self, k: int) -> int:
        k = min(k, len(self.tokens) - 1)
        return self.line[k] + self.tokens[k].count("\n")

    def cut(self, start: int, end: int) -> str:
        a = self.at[start]
        b = self.at[min(end, len(self.tokens) - 1)] + len(self.tokens[min(end, len(self.tokens) - 1)])
        return self.text[a : min(b, a + 200)]

    def skip_types(self, k: int) -> int:
        """Behind an angle-bracketed list that starts at ``k``, else ``k``."""
        if self.get(k) != "<":
            return k
        if self.angles is None:
            self.angles = self._match_angles()
        return self.angles.get(k, k - 1) + 1

    def _match_angles(self) -> dict[int, int]:
        """Ends of the angle brackets, in one pass: those of a bracketed part match within it only,
        and none reaches over a token that stands in no list of types."""
        out: dict[int, int] = {}
        levels: list[list[int]] = [[]]
        closing = set(self.match.values())
        for k, token in enumerate(self.tokens):
            if k in self.match:
                levels.append([])
            elif k in closing:
                levels.pop()
            elif token in _NO_TYPE or (len(token) == 1 and token in _OPEN + _CLOSE):
                levels[-1].clear()
            elif token[0] == "<" and token in ("<", "<<", "<-"):
                levels[-1] += [k] * token.count("<")
            elif token[0] == ">" and token not in (">=",):
                for _ in range(token.count(">")):
                    if levels[-1]:
                        out[levels[-1].pop()] = k
        return out

    def skip_annotation(self, k: int, stops: tuple[str, ...]) -> int:
        """The first of ``stops`` behind the annotation that starts at the colon ``k``, else ``k``.

        Bracketed parts are skipped; a token that no type holds ends the search, so that searches
        from different declarations read different tokens.
        """
        j = k + 1
        while j < len(self.tokens) and self.tokens[j] not in _NO_TYPE and self.tokens[j] not in _STARTS and self.tokens[j] not in _CLOSE:
            if self.tokens[j] in stops:
                return j
            if self.tokens[j] == "<":
                j = max(self.skip_types(j), j + 1)
            else:
                j = self.match.get(j, j) + 1
        return k

    def body(self, k: int, stop: str = ";") -> int | None:
        """The next opening brace from ``k`` on, before ``stop``; bracketed parts are skipped."""
        while k < len(self.tokens):
            token = self.tokens[k]
            if token == "{":
                return k
            if token == stop or token == "}":
                return None
            k = self.match.get(k, k) + 1
        return None

    def calls(self, callers: list[tuple[int, int, str]], members: bool) -> list[Symbol]:
        out = []
        for k in range(1, len(self.tokens)):
            if self.tokens[k] != "(" or not self.is_name(k - 1):
                continue
            name, before = self.tokens[k - 1], self.get(k - 2)
            if name in _NOT_CALLED or before in ("function", "func", "fn", "new", "def", "#", "::", "!", "class"):
                continue
            if before in (".", "?.", "->") and not members:
                continue
            caller = next((n for a, b, n in reversed(callers) if a <= k <= b), "")
            if any(a == k - 1 for a, _, _ in callers):
                continue  # the declaration itself
            out.append(Symbol("call", name, self.line[k - 1], self.end_line(self.match.get(k, k)), caller_name=caller))
        return out


def _declared(s: _Stream, kind: str, name_at: int, start: int, end: int, owner: str = "") -> Symbol:
    return Symbol(kind, s.tokens[name_at], s.line[start], s.end_line(end), s.cut(start, end), owner)


def _quoted(token: str) -> str:
    return token[1:-1] if len(token) > 1 and token[0] in "\"'`" else token


def _script(text: str, name: str) -> list[Symbol]:
    """TypeScript, TSX and JavaScript."""
    s = _Stream(text, name)
    functions, arrows, methods, classes, types, imports = [], [], [], [], [], []
    spans: list[tuple[int, int, str]] = []
    bodies: dict[int, str] = {}
    for k, token in enumerate(s.tokens):
        if token == "class" and s.is_name(k + 1) and s.get(k - 1) not in (".", "?."):
            brace = s.body(k + 2)
            if brace is not None and brace in s.match:
                start = k - 1 if s.get(k - 1) == "abstract" else k
                if start == k:
                    classes.append(_declared(s, "class", k + 1, k, s.match[brace]))
                    bodies[brace] = s.tokens[k + 1]
        elif token == "function" and s.get(k - 1) not in (".", "?."):
            at = k + 1
            if s.is_name(at) and s.get(k - 1) not in ("=", "(", ",", ":", "return", "=>", "!", "?", "&&", "||"):
                opened = s.skip_types(at + 1)
                brace = s.body(s.match.get(opened, opened) + 1) if s.get(opened) == "(" else None
                if brace is not None and brace in s.match:
                    start = k - 1 if s.get(k - 1) == "async" else k
                    functions.append(_declared(s, "function", at, start, s.match[brace]))
                    spans.append((at, s.match[brace], s.tokens[at]))
        elif token in ("const", "let", "var") and s.depth_owner[k] == -1 and s.is_name(k + 1):
            at, j = k + 1, k + 2
            j += s.get(j) == "!"
            if s.get(j) == ":":
                j = s.skip_annotation(j, ("=",))
            if s.get(j) == "=":
                j += 1
                j += s.get(j) == "async"
                j = s.skip_types(j)
                if s.get(j) == "(" and j in s.match:
                    j = s.match[j] + 1
                    if s.get(j) == ":":
                        j = s.skip_annotation(j, ("=>",))
                elif s.is_name(j):
                    j += 1
                if s.get(j) == "=>":
                    end = s.match.get(j + 1) if s.get(j + 1) == "{" else None
                    if end is None:
                        end = j + 1
                        while end < len(s.tokens) and s.tokens[end] != ";":
                            end = s.match.get(end, end) + 1
                    arrows.append(_declared(s, "function", at, at, min(end, len(s.tokens) - 1)))
                    spans.append((at, end, s.tokens[at]))
        elif token in ("interface", "type") and name != "javascript" and s.is_name(k + 1) and s.get(k - 1) not in (".", "?.", "import", "{", ",") or (
            token == "interface" and name != "javascript" and s.is_name(k + 1) and s.get(k - 1) in ("{", "}")
        ):
            if token == "interface":
                brace = s.body(k + 2)
                if brace is not None and brace in s.match:
                    types.append(_declared(s, "type", k + 1, k, s.match[brace]))
            elif s.get(s.skip_types(k + 2)) == "=":
                end = k + 3
                while end < len(s.tokens) and s.tokens[end] != ";":
                    end = s.match.get(end, end) + 1
                types.append(_declared(s, "type", k + 1, k, min(end, len(s.tokens) - 1)))
        elif token == "import" and s.depth_owner[k] == -1 and s.get(k + 1) not in ("(", "."):
            names, j = [], k + 1
            while j < len(s.tokens) and s.tokens[j][0] not in "\"'" and s.tokens[j] not in (";", "import") and s.tokens[j] not in _STARTS:
                if s.tokens[j] == "{":
                    inner = s.tokens[j + 1 : s.match.get(j, j)]
                    names += [t for t, before in zip(inner, ["", *inner], strict=False) if _IDENT.match(t) and t not in ("as", "type") and before != "as"]
                    j = s.match.get(j, j)
                elif s.tokens[j] == "*":
                    names.append("*")
                    j += 2
                elif s.is_name(j) and s.tokens[j] not in ("from", "type"):
                    names.append(s.tokens[j])
                j += 1
            if j < len(s.tokens) and s.tokens[j][0] in "\"'":
                module = _quoted(s.tokens[j])
                imports.append(Symbol("import", module, s.line[k], s.end_line(j), module_path=module, symbols=tuple(names)))
    for brace, owner in bodies.items():
        k = brace + 1
        while k < s.match[brace]:
            opened = s.skip_types(k + 1)
            if s.is_name(k) and s.get(opened) == "(" and opened in s.match and s.get(k - 1) not in (".", "=", "new", "@"):
                j = s.match[opened] + 1
                if s.get(j) == ":":
                    while j < s.match[brace] and s.tokens[j] not in ("{", ";"):
                        j = s.match.get(j, j) + 1 if s.tokens[j] != "{" else j
                if s.get(j) == "{" and j in s.match:
                    start = k
                    while s.get(start - 1) in ("async", "static", "public", "private", "protected", "readonly", "override", "get", "set", "*"):
                        start -= 1
                    methods.append(_declared(s, "function", k, start, s.match[j], owner))
                    spans.append((k, s.match[j], s.tokens[k]))
                    k = s.match[j] + 1
                    continue
            k = s.match.get(k, k) + 1
    spans.sort()
    return [*functions, *arrows, *methods, *classes, *types, *imports, *s.calls(spans, members=True)]


def _go(text: str, name: str) -> list[Symbol]:
    s = _Stream(text, name)
    functions, methods, classes, types, imports, spans = [], [], [], [], [], []
    for k, token in enumerate(s.tokens):
        if s.depth_owner[k] != -1:
            continue
        if token == "func":
            owner, at = "", k + 1
            if s.get(at) == "(" and at in s.match:
                inside = [t for t in s.tokens[at + 1 : s.match[at]] if _IDENT.match(t)]
                owner = inside[1] if len(inside) > 1 else inside[0] if inside else ""
                at = s.match[at] + 1
                if not owner:
                    continue
            if not s.is_name(at):
                continue
            j = at + 1
            if s.get(j) == "[":
                j = s.match.get(j, j) + 1
            brace = None
            j = s.match.get(j, j) + 1
            while j < len(s.tokens) and s.tokens[j] not in ("func", "type", "var", "const", "import"):
                if s.tokens[j] == "{" and s.get(j - 1) not in ("interface", "struct"):
                    brace = j
                    break
                j = s.match.get(j, j) + 1
            if brace is not None and brace in s.match:
                (methods if owner else functions).append(_declared(s, "function", at, k, s.match[brace], owner))
                spans.append((at, s.match[brace], s.tokens[at]))
        elif token == "type":
            entries = [k + 1]
            if s.get(k + 1) == "(" and k + 1 in s.match:
                entries = [j for j in range(k + 2, s.match[k + 1]) if s.is_name(j) and s.get(j + 1) in ("struct", "interface")]
            for at in entries:
                j = at + 1
                if s.get(j) == "[":
                    j = s.match.get(j, j) + 1
                if s.is_name(at) and s.get(j) in ("struct", "interface") and s.get(j + 1) == "{" and j + 1 in s.match:
                    start = k if entries == [k + 1] else at
                    row = _declared(s, "class" if s.get(j) == "struct" else "type", at, start, s.match[j + 1])
                    (classes if s.get(j) == "struct" else types).append(row)
        elif token == "import":
            stop = s.match.get(k + 1, k + 2) if s.get(k + 1) == "(" else k + 2
            for j in range(k + 1, min(stop + 1, len(s.tokens))):
                if s.tokens[j][0] in "\"`":
                    alias = s.get(j - 1)
                    path = _quoted(s.tokens[j])
                    names = (alias,) if (_IDENT.match(alias) and alias != "import") or alias in (".", "_") else ()
                    imports.append(Symbol("import", path, s.line[j], s.line[j], module_path=path, symbols=names))
                    if s.get(k + 1) != "(":
                        break
    spans.sort()
    return [*functions, *methods, *classes, *types, *imports, *s.calls(spans, members=False)]


def _rust(text: str, name: str) -> list[Symbol]:
    s = _Stream(text, name)
    free, methods, classes, types, imports, spans = [], [], [], [], [], []
    impls: dict[int, str] = {}
    for k, token in enumerate(s.tokens):
        if token == "impl" and s.get(k - 1) not in ("->", ":", "&", "(", ",", "<", "="):
            brace = s.body(k + 1)
            if brace is not None and brace in s.match:
                j = s.skip_types(k + 1)
                heads, depth = [], 0
                while j < brace:
                    t = s.tokens[j]
                    if t == "where":
                        break
                    depth += (t == "<") - (t == ">")
                    if depth == 0 and s.is_name(j) and t not in ("for", "dyn", "mut", "const", "unsafe"):
                        heads.append(t)
                    j += 1
                if heads:
                    impls[brace] = heads[-1]
    for k, token in enumerate(s.tokens):
        if token == "fn" and s.is_name(k + 1):
            brace = s.body(s.match.get(s.skip_types(k + 2), k + 2) + 1)
            if brace is None or brace not in s.match:
                continue
            start = k
            while s.get(start - 1) in ("pub", "async", "unsafe", "const", "extern", ")") and start > 0:
                if s.get(start - 1) == ")":
                    opened = next((a for a, b in s.match.items() if b == start - 1), None)
                    if opened is None or s.get(opened - 1) != "pub":
                        break
                    start = opened - 1
                else:
                    start -= 1
            owner = impls.get(s.depth_owner[k])
            inside = any(a < k < b for a, b, _ in spans)
            if owner:
                methods.append(_declared(s, "function", k + 1, start, s.match[brace], owner))
            elif not inside:
                free.append(_declared(s, "function", k + 1, start, s.match[brace]))
            spans.append((k + 1, s.match[brace], s.tokens[k + 1]))
        elif token == "struct" and s.is_name(k + 1):
            end = k + 2
            while end < len(s.tokens) and s.tokens[end] not in (";", "{"):
                end = s.match.get(end, end) + 1
            end = s.match.get(end, end)
            classes.append(_declared(s, "class", k + 1, k - 1 if s.get(k - 1) == "pub" else k, end))
        elif token == "type" and s.is_name(k + 1) and s.get(s.skip_types(k + 2)) == "=" and s.depth_owner[k] == -1:
            end = k
            while end < len(s.tokens) and s.tokens[end] != ";":
                end = s.match.get(end, end) + 1
            types.append(_declared(s, "type", k + 1, k - 1 if s.get(k - 1) == "pub" else k, end))
        elif token == "use" and s.get(k - 1) not in (".",):
            end = k
            while end < len(s.tokens) and s.tokens[end] != ";":
                end = s.match.get(end, end) + 1
            if end < len(s.tokens) and end > k + 1:
                path = s.text[s.at[k + 1] : s.at[end]].strip()
                imports.append(Symbol("import", path, s.line[k], s.line[end], module_path=path))
    spans.sort()
    return [*methods, *free, *classes, *types, *imports, *s.calls(spans, members=False)]


_INCLUDE = re.compile(r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"])([^>\"\n]+)[>\"]")


def _cpp(text: str, name: str, compat: bool) -> list[Symbol]:
    s = _Stream(text, name)
    functions, classes, imports, spans = [], [], [], []
    bodies: dict[int, str] = {}
    scopes = {-1}
    heads: dict[int, int] = {}  # where the search for a body ends, by the tokens that it has passed
    for k, token in enumerate(s.tokens):
        if token in ("class", "struct") and s.is_name(k + 1) and s.get(k - 1) not in ("enum", "<", ",", "friend"):
            brace = s.body(k + 2)
            between = s.tokens[k + 2 : brace] if brace is not None else ["("]
            if brace is not None and brace in s.match and "(" not in between and "=" not in between:
                classes.append(_declared(s, "class", k + 1, k, s.match[brace]))
                bodies[brace] = s.tokens[k + 1]
        elif token in ("namespace", "extern"):
            brace = s.body(k + 1)
            if brace is not None and "(" not in s.tokens[k:brace] and s.depth_owner[k] in scopes:
                scopes.add(brace)
    for k, token in enumerate(s.tokens):
        if token != "(" or not s.is_name(k - 1) or k not in s.match:
            continue
        around = s.depth_owner[k]
        owner = bodies.get(around, "")
        if around not in scopes and not owner:
            continue
        if s.tokens[k - 1] in _NOT_CALLED or s.get(k - 2) in (".", "->", "=", "return", ","):
            continue
        if s.get(k - 2) == ":" and s.get(k - 3) not in ("public", "private", "protected"):
            continue  # an initialiser of a constructor
        j, passed = s.match[k] + 1, []
        while j < len(s.tokens) and j not in heads and s.tokens[j] not in ("{", ";", "}", "="):
            passed.append(j)
            j = s.match.get(j, j) + 1
        j = heads.get(j, j)
        heads.update(dict.fromkeys(passed, j))
        if s.get(j) != "{" or j not in s.match:
            continue
        start = k - 1
        while start > 0 and s.tokens[start - 1] not in (";", "}", "{") and not (s.tokens[start - 1] == ":" and s.get(start - 2) in ("public", "private", "protected")) and not s.tokens[start - 1].lstrip().startswith("#"):
            start -= 1
        special = s.get(k - 2) == "~" or s.tokens[k - 1] == owner
        if owner and compat and not special:
            continue
        functions.append(_declared(s, "function", k - 1, start, s.match[j], owner))
        spans.append((k - 1, s.match[j], s.tokens[k - 1]))
    for m in _INCLUDE.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        imports.append(Symbol("import", m[2], line, line, module_path=m[2]))
    spans.sort()
    return [*functions, *classes, *imports, *s.calls(spans, members=False)]


def extract(text: str | None, name: str | None, compat: bool = False) -> list[Symbol]:
    """All symbols of a text in emission order. ``compat`` leaves out decorated Python functions,
    Python calls, aliased Python imports and ordinary C++ methods."""
    if not text or name is None:
        return []
    text = lexer.normal(text)
    if name == "python":
        return _python(text, compat)
    if name in ("typescript", "tsx", "javascript"):
        return _script(text, name)
    if name == "go":
        return _go(text, name)
    if name == "rust":
        return _rust(text, name)
    if name == "cpp":
        return _cpp(text, name, compat)
    return []


def parse_files(files: DataFrame, path: str = "relative_path", content: str = "content", compat: bool = False) -> DataFrame:
    """Tagged symbol rows of files (repo_id, path, content). One pass over the text, map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                for k, s in enumerate(extract(r.content, r.language, compat)):
                    out.append((r.repo_id, r.file_path, s.kind, k, s.name, s.class_name, s.start_line, s.end_line, s.signature, r.language, s.module_path, list(s.symbols), s.caller_name))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    named = files.select("repo_id", F.col(path).alias("file_path"), F.col(content).alias("content"), language(F.col(path)).alias("language"))
    return named.where("language IS NOT NULL AND content IS NOT NULL").mapInPandas(run, ROWS)
