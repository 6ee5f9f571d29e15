"""Functions paired with their documentation (problem 5).

Packrat parsing-expression grammars, one per language family, read the documentation comments,
attributes and header of a function and keep their offsets in the source. Semantic actions emit
the pair; a filter on the informativeness of the description follows.

A description is what is left of the documentation after tags, dividers, to-do notes, licences,
tool directives, placeholders and disabled code are taken out. It has to have at least four words
(eight characters in scripts without spaces) and a word that is neither part of the names of the
symbol and its parameters nor a filler word.

Defined results: rows that are no functions (``symbol_type``, case and outer blanks ignored), with
null or empty text, or whose text the grammar does not recognise have a null description and are
left out of the pairs. Repeated rows are repeated. Input columns keep their names; the result of
``extract`` is one new struct column ``doc``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- packrat parsing ---------------------------------------------------------------------------

#: A parser takes (text, position, memo) and gives (end, captures) or None.
Parser = Callable[[str, int, dict], "tuple[int, tuple] | None"]


def token(pattern: str) -> Parser:
    match = re.compile(pattern).match

    def parse(text: str, at: int, memo: dict):
        m = match(text, at)
        return (m.end(), ()) if m else None

    return parse


def seq(*parts: Parser) -> Parser:
    def parse(text: str, at: int, memo: dict):
        got: tuple = ()
        for part in parts:
            found = part(text, at, memo)
            if found is None:
                return None
            at, more = found
            if more:
                got += more
        return at, got

    return parse


def first(*choices: Parser) -> Parser:
    def parse(text: str, at: int, memo: dict):
        for choice in choices:
            found = choice(text, at, memo)
            if found is not None:
                return found
        return None

    return parse


def many(part: Parser) -> Parser:
    def parse(text: str, at: int, memo: dict):
        got: list = []
        while True:
            found = part(text, at, memo)
            if found is None or found[0] == at:
                return at, tuple(got)
            at = found[0]
            got += found[1]

    return parse


def maybe(part: Parser) -> Parser:
    return lambda text, at, memo: part(text, at, memo) or (at, ())


def rule(name: str, part: Parser, keep: bool = False) -> Parser:
    """A memoised rule; with ``keep`` its span (name, start, end) is captured."""

    def parse(text: str, at: int, memo: dict):
        key = (name, at)
        if key not in memo:
            found = part(text, at, memo)
            if found is not None and keep:
                found = found[0], ((name, at, found[0]), *found[1])
            memo[key] = found
        return memo[key]

    return parse


def balanced(opening: str, closing: str, inside: Parser) -> Parser:
    """A bracketed span of any depth; ``inside`` reads what is no bracket. Not recursive, so depth
    costs no stack."""

    def parse(text: str, at: int, memo: dict):
        if not text.startswith(opening, at):
            return None
        depth, at = 1, at + 1
        while depth:
            found = inside(text, at, memo)
            if found is not None and found[0] > at:
                at = found[0]
            elif text.startswith(opening, at):
                depth, at = depth + 1, at + 1
            elif text.startswith(closing, at):
                depth, at = depth - 1, at + 1
            else:
                return None
        return at, ()

    return parse


_STRING = r'"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|`(?:[^`\\]|\\[\s\S])*`'
_NAME = r"[A-Za-z_$\u0080-￿][\w$]*"


def _grammar(family: str) -> Parser:
    text = token(rf"(?:[^()\"'`]|'(?=\w+\b(?!')))+")
    params = rule("params", balanced("(", ")", many(first(text, token(_STRING), token("['\"`]")))), keep=True)
    blank = rule("blank", token(r"[ \t\f]*\r?\n"), keep=True)
    name = rule("name", token(_NAME), keep=True)
    group = balanced("(", ")", many(first(text, token(_STRING), token("['\"`]"))))
    braces = balanced("{", "}", first(token(r"[^{}\"'`]+"), token(_STRING), token("['\"`]")))
    brackets = balanced("[", "]", first(token(r"[^\[\]\"'`]+"), token(_STRING), token("['\"`]")))
    angles = balanced("<", ">", first(token(r"(?:->|=>|[^<>(){};\"'`]|'(?=\w+\b(?!')))+"), group, braces, token(_STRING)))
    types = maybe(seq(token(r"\s*"), angles))
    line_end = token(r"[ \t]*\r?\n")
    decorator = first(seq(token(r"[ \t]*@[\w.]+"), group, line_end), token(r"[ \t]*@[^\n]*\n"))
    line = token(r"[ \t]*//[^\n]*(?:\n|$)")
    block = token(r"[ \t]*/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/[ \t]*\r?\n?")
    if family == "python":
        comment = rule("comment", token(r"[ \t]*#[^\n]*(?:\n|$)"), keep=True)
        attribute = rule("attribute", decorator, keep=True)
        head = seq(token(r"[ \t]*(?:async[ \t]+)?def[ \t]+"), name, maybe(brackets), token(r"[ \t]*"), params, token(r"(?:[ \t]*->[^\n]*?)?[ \t]*:"))
        gap = many(token(r"[ \t]*(?:#[^\n]*)?\r?\n"))
        triple = r'[rRuUbB]{0,2}(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\')'
        single = r'[rRuUbB]{0,2}(?:"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\')'
        string = rule("docstring", token(rf"(?:{triple}|{single})(?=[ \t]*(?:[;#\r\n]|$))"), keep=True)
        header = seq(head, maybe(seq(gap, token(r"[ \t]*"), string)))
    else:
        comment = rule("comment", first(line, block), keep=True)
        if family == "rust":
            attribute = rule("attribute", seq(token(r"[ \t]*#!?"), brackets, line_end), keep=True)
            header = seq(token(r"\s*+(?:(?:pub(?:\([^)]*\))?|async|unsafe|const|default|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+"), name, types, token(r"\s*"), params)
        elif family == "go":
            attribute = rule("attribute", token(r"[ \t]*@[^\n]*\n"), keep=True)
            receiver = maybe(seq(token(r"\([^()]*\)\s*")))
            header = seq(token(r"\s*+func\s+"), receiver, name, maybe(brackets), params)
        elif family == "cpp":
            template = seq(token(r"[ \t]*template\s*"), angles, line_end)
            attribute = rule("attribute", first(template, seq(token(r"[ \t]*(?=\[\[)"), brackets, line_end), token(r"[ \t]*#[^\n]*\n")), keep=True)
            # Specifiers and the type, word by word; then qualifiers and the name before a bracket.
            before_name = r"[*&]*+(?:[\w<>]++::)*+~?(?=[A-Za-z_]\w*+\s*+\()"
            header = seq(maybe(seq(token(r"\s*template\s*"), angles)), token(rf"\s*+(?:[\w:~&*<>,\[\]]++\s++)*?{before_name}"), name, token(r"\s*"), params)
        else:
            attribute = rule("attribute", decorator, keep=True)
            words = r"\s*+(?:(?:export|default|declare|async|static|public|private|protected|readonly|override|abstract|get|set)\s+)*"
            plain = seq(token(words + r"(?:function\s*\*?\s*)?\*?#?"), name, types, token(r"\s*"), params)
            arrow = seq(token(words + r"(?:const|let|var)\s+"), name, token(r"(?:\s*:[^=]+)?\s*=\s*(?:async\s+)?(?:function\s*\w*\s*)?"), types, token(r"\s*"), params)
            bare = seq(token(words + r"(?:const|let|var)\s+"), name, token(r"\s*=\s*(?:async\s+)?\w+\s*=>"))
            header = first(arrow, bare, plain)
    lead = many(rule("lead", first(blank, comment, attribute)))
    return seq(token("﻿?"), lead, rule("header", header, keep=True))


@lru_cache(maxsize=None)
def grammar(family: str) -> Parser:
    return _grammar(family)


_FAMILY = {"py": "python", "rs": "rust", "go": "go", "cpp": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp", "ts": "js", "tsx": "js", "js": "js", "mjs": "js"}
_LANGUAGE = {"python": "python", "rust": "rust", "go": "go", "cpp": "cpp", "typescript": "js", "tsx": "js", "javascript": "js"}


def family_of(path: str | None, language: str | None) -> str | None:
    suffix = (path or "").strip().rpartition(".")[2].lower()
    return _FAMILY.get(suffix) or _LANGUAGE.get((language or "").strip().lower())


# --- informativeness ---------------------------------------------------------------------------

# Words that add nothing to the names.
FILLERS = frozenset(
    """a an the this that these those of for to in on at by with and or from as is are be it its will does do given
    method function func fn procedure routine helper internal private public class object value values param params
    parameter parameters argument arguments returns return""".split()
)
_DIRECTIVE = re.compile(
    r"(?i)^(?:eslint|tslint|jshint|prettier|biome|istanbul|c8 ignore|ts-|@ts-|@flow|@jsx|noqa|pylint|pyright|mypy|type: ?ignore|flake8|ruff|isort|fmt: ?(?:on|off|skip)|yapf|pragma|nosec|nolint|NOLINT|go:|\+build|lint:|rustfmt|clippy|clang-format|clang-tidy|cppcheck|coverity|sonar|NOSONAR|spell-?checker|cspell|codecov|region|endregion|#region|#endregion|webpack|vim:|-\*-)"
)
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|wip|tbd|tba|placeholder|to be (?:done|written|documented)|stub)\b")
_BARE_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|wip|tbd|tba|placeholder|stub)\W*$")
_LICENCE = re.compile(
    r"(?i)^\W*(?:\(c\)|©|copyright\b|spdx-|licen[cs]ed under|all rights reserved|released under|distributed under|this (?:file|code|software|program) is (?:free|licen[cs]ed|distributed)|permission is hereby|the above copyright|redistribution and use)|\bdistributed under an? [\w-]+ licen[cs]e"
)
_EMPTY_PHRASE = re.compile(
    r"(?i)^\W*(?:(?:no|missing|add|insert|write|needs?) (?:a )?(?:description|documentation|docs?|docstring|comment)\b.*|(?:description|documentation|docs?|docstring|comment)s? (?:goes here|pending|missing|to follow|here|needed|todo)|not (?:yet )?documented.*|undocumented.*|self[- ]explanatory|see (?:above|below|name|code)|internal(?: helper)?(?: function)?|helper(?: function| method)?|lorem ipsum.*|(?:old|older|outdated|stale|temporary) (?:comment|docs?|text),? (?:to be|will be|should be) (?:replaced|rewritten|updated|removed)[^.]*|\{?@?inherit-?doc\}?|same as above|as above|n/?a|none)\W*$"
)
_TAG = re.compile(r"^\s*(?:[@\\][A-Za-z]+\b|:[A-Za-z]+(?:\s+[\w.*]+)*:|(?:Args|Arguments|Parameters|Params|Returns|Return|Raises|Yields|Throws)\s*:\s*$)")
#: Tags that introduce the description itself.
_LEADING_TAG = re.compile(r"^\s*[@\\](?:brief|summary|description|desc|details|remarks|abstract|short)\b:?\s*")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[})\]]|:=|^\s*(?:return|if|for|while|switch|try|else|case|const|let|var|import|from|def|fn|func|await|throw|raise|break|continue|with|assert|defer|go|match|except|elif)\b.*[:({\[=;]\s*$|^\s*[\w.$>-]+(?:\[[^\]]*\])?\s*(?:[-+*/|&]?=)\s*\S|^\s*(?:(?:await|defer|go|yield|return|throw|new|delete)\s+)?[\w.$:>-]+\(.*\)[;,]?\s*$|^\s*(?:return|throw|raise|break|continue|pass|assert)\b(?!.*\s\w+\s\w+\s\w+\s\w+)|=>|^\s*//|^\s*#\s"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SPACELESS = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


def name_words(text: str) -> set[str]:
    """Lower-cased parts of the identifiers of a text (camel case and underscores split)."""
    return {p.lower() for p in _PIECES.findall(text.replace("_", " "))}


def _plain_lines(comment: str) -> list[str]:
    """Lines of a comment or string without its markers."""
    lines = comment.replace("\r", "").removesuffix("\n").split("\n")
    out = []
    for line in lines:
        line = line.strip()
        line = re.sub(r"^(?:/\*+!?|//[/!]?|\*+/|\*(?!\*)(?=\s|$)|\*/|#+!?(?=\s|$|[^\[\w!]))", "", line, count=1)
        line = re.sub(r"\*+/\s*$", "", line)
        out.append(line.strip())
    return out


def _docstring_lines(text: str) -> list[str]:
    body = re.sub(r"^[rRuUbB]{0,2}", "", text)
    quote = body[:3] if body[:3] in ('"""', "'''") else body[:1]
    return [x.strip() for x in body[len(quote) : -len(quote)].replace("\r", "").split("\n")]


_LITERAL = re.compile(_STRING)
_PROSE = re.compile(r"[^\W\d_]{2,} [^\W\d_]+,? [^\W\d_]+,? [^\W\d_]+,? [^\W\d_]+")


def _code_lines(lines: list[str]) -> list[bool]:
    """Lines that read as statements; words inside string literals do not make prose."""
    out = []
    for line in lines:
        bare = _LITERAL.sub('""', line)
        out.append(bool(line) and bool(_CODE.search(bare)) and (not _PROSE.search(bare) or bare.endswith(";") and "(" in bare))
    return out


def description(lines: list[str], names: set[str]) -> str | None:
    """The informative part of documentation lines, or null."""
    kept: list[str] = []
    skipping = tagging = False
    lines = [_LEADING_TAG.sub("", x) for x in lines]
    code = _code_lines(lines)
    if any(code) and sum(code) >= 0.5 * sum(map(bool, lines)):  # disabled code with its own remarks
        return None
    for line, is_code in zip(lines, code, strict=True):
        if not line:
            skipping = tagging = False
            kept.append("")
            continue
        if _DIRECTIVE.match(line):
            skipping = tagging = False
            continue
        if not _WORD.search(line):
            continue
        if re.fullmatch(r"[=\-*#~_+/.<>| ]{2,}\s*[\w -]{0,40}?\s*[=\-*#~_+/.<>| ]{2,}", line):
            skipping = False
            continue
        if _TAG.match(line):
            tagging, skipping = True, False
            continue
        if tagging:
            continue
        if _BARE_TODO.match(line) or _EMPTY_PHRASE.match(line):
            skipping = False
            continue
        if _TODO.match(line) or _LICENCE.search(line):
            skipping = True
            continue
        if skipping and (line[:1].islower() or line[:1] in "(,"):
            continue
        skipping = False
        if is_code:
            continue
        kept.append(line)
    text = " ".join(kept).strip()
    text = re.sub(r"\s+", " ", text)
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s and not _TODO.match(s) and not _LICENCE.search(s) and not _EMPTY_PHRASE.match(s)]
    text = " ".join(sentences)
    text = re.sub(r"\{?@\w+[^}]*\}", " ", text) if text.startswith("{") else text
    bare = re.sub(r"\s@\w+(?: \w+)?", " ", f" {text}") if "@" in text else text
    spaceless = len(_SPACELESS.findall(bare))
    words = _WORD.findall(bare)
    if spaceless:
        return text if spaceless >= 8 else None
    if len(words) < 4:
        return None
    for word in words:
        parts = name_words(word)
        if any(p not in names and p not in FILLERS and not (p.endswith("s") and p[:-1] in names) for p in parts):
            return text
    return None


def pair(text: str | None, path: str | None, language: str | None, symbol: str | None) -> tuple | None:
    """(description, start of documentation, its end, start of the code), or null."""
    family = family_of(path, language)
    if not text or family is None:
        return None
    found = grammar(family)(text, 0, {})
    if found is None:
        return None
    spans = found[1]
    header = next(s for s in spans if s[0] == "header")
    known = (symbol or "") + " " + " ".join(text[a:b] for kind, a, b in spans if kind in ("name", "params"))
    names = name_words(known)
    comments, blanks = [], 0
    for kind, a, b in reversed([s for s in spans if s[0] in ("blank", "comment", "attribute")]):
        if kind == "blank":
            blanks += 1
            if blanks > 1:
                break
            continue
        if kind == "attribute":
            continue
        blanks = 0
        comments.append((a, b))
    comments.reverse()
    strings = [(a, b) for kind, a, b in spans if kind == "docstring"]
    for a, b in strings:
        told = description(_docstring_lines(text[a:b]), names)
        if told:
            return told, a, b, header[1]
    if comments:
        told = description([x for a, b in comments for x in _plain_lines(text[a:b])], names)
        if told:
            return told, comments[0][0], comments[-1][1], header[1]
    return None


DOC = "struct<description:string, doc_start:int, doc_end:int, code_start:int>"


def is_kind(symbol_type: Column, kinds: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_replace(symbol_type, r"^\s+|\s+$", "")).isin(*kinds)


def extract(chunks: DataFrame, kinds: tuple[str, ...] = ("function",)) -> DataFrame:
    """Chunks of the kinds plus ``doc``, null where there is no informative description. Map-only."""

    @F.pandas_udf(DOC)
    def read(text: pd.Series, path: pd.Series, language: pd.Series, symbol: pd.Series) -> pd.DataFrame:
        rows = [pair(*x) or (None,) * 4 for x in zip(text, path, language, symbol, strict=True)]
        return pd.DataFrame(rows, columns=["description", "doc_start", "doc_end", "code_start"]).astype({c: "Int32" for c in ("doc_start", "doc_end", "code_start")})

    return chunks.where(is_kind(F.col("symbol_type"), kinds)).withColumn("doc", read("source_text", "file_path", "language", "symbol_name"))


def pairs(chunks: DataFrame) -> DataFrame:
    """One row per described function or method: its description and its code without leading comments."""
    described = extract(chunks, ("function", "method")).where("doc.description IS NOT NULL")
    return described.select(
        "chunk_id",
        "symbol_name",
        F.col("doc.description").alias("description"),
        F.expr("substring(source_text, doc.code_start + 1)").alias("code"),
        F.col("doc.doc_start").alias("doc_start"),
        F.col("doc.doc_end").alias("doc_end"),
    )
