"""Tokens of the indexed languages by one compiled pattern per language.

``tokens(text, language)`` returns the tokens in order; white space and comments are tokens too,
so the tokens concatenate to the text and carry offsets. Characters that start no token come
out one by one and are lexical errors.
"""

from __future__ import annotations

import re
from functools import lru_cache

_SPACE = r"[^\S\n]+|\n"
_LINE = r"//[^\n]*"
#: A comment that is never closed runs to the end, so that it is looked for once.
_OPEN_COMMENT = r"/\*[\s\S]*+"
_BLOCK = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/|" + _OPEN_COMMENT
#: Rust's block comments nest; three levels are followed.
_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)*\*/" + "|" + _OPEN_COMMENT
_NUMBER = r"(?:0[xXbBoO][\da-fA-F_']+|\d[\d_']*(?:\.\d[\d_']*)?(?:[eE][+-]?\d+)?)[A-Za-z_0-9]*"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_WORD = r"[A-Za-z_$\u0080-\U0010ffff][\w$]*"
_OPS = r"<<=|>>=|\*\*=|===|!==|\?\?=|&&=|\|\|=|\.\.\.|\.\.=|<=>|->\*|=>|->|::|:=|<-|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\*\*|\+\+|--|\+=|-=|\*=|/=|%=|&\^=|&=|\|=|\^=|&\^|\.\.|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@#]"

#: A slash after one of these starts a regular expression literal, not a division.
_BEFORE_REGEX = r"[(,=:\[!&|?{};+*%~^]"
_REGEX_BODY = r"/(?![*/])(?:[^\\/\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_JS_REGEX = rf"(?:(?<={_BEFORE_REGEX})|(?<={_BEFORE_REGEX} )|(?<=return )|(?<=^)){_REGEX_BODY}"
#: Where tags are read, a slash before the end of a tag starts no literal.
_TSX_REGEX = rf"(?!/>)(?:{_JS_REGEX})"
_TEMPLATE = r"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]++|\{[^{}]*+\}|`[^`]*+`)*+\})*+`"
#: The end of a tag with the text up to the next tag; text may hold quotes that open nothing.
_JSX_TEXT = r">[^<>{}=;()]*(?=</[A-Za-z>])"
_CONFLICT = r"(?m:^(?:<{7}|>{7}|={7}|\|{7})(?=[ \n]|$)[^\n]*)"

_PATTERNS = {
    "tsx": "|".join([_SPACE, _JSX_TEXT, _CONFLICT, _LINE, _BLOCK, _DQ, _SQ, _TEMPLATE, _TSX_REGEX, _NUMBER, r"\#" + _WORD, _WORD, _OPS]),
    "js": "|".join([_SPACE, _CONFLICT, _LINE, _BLOCK, _DQ, _SQ, _TEMPLATE, _JS_REGEX, _NUMBER, r"\#" + _WORD, _WORD, _OPS]),
    "go": "|".join([_SPACE, _CONFLICT, _LINE, _BLOCK, _DQ, r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'", r"`[^`]*`", _NUMBER, _WORD, _OPS]),
    "rust": "|".join(
        [
            _SPACE, _CONFLICT, _LINE, _NESTED,
            r'[bc]?r"[^"]*"', r'[bc]?r\#"[\s\S]*?"\#', r'[bc]?r\#\#+"[\s\S]*?"\#\#+', r'[bc]?"(?:[^"\\]|\\[\s\S])*"', r"b?'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|.))'",
            r"'[A-Za-z_]\w*(?!')", _NUMBER, r"r\#" + _WORD, _WORD, _OPS,
        ]
    ),
    "cpp": "|".join(
        [
            _SPACE, _CONFLICT, _LINE, _BLOCK, r"(?m:^[^\S\n]*\#(?:[^\n\\]|\\[\s\S])*)",
            r'(?:u8|[uUL])?R"\([\s\S]*?\)"', r'(?:u8|[uUL])?R"[^()\\\s"]{1,16}\([\s\S]*?\)[^()\\\s"]{1,16}"', r'(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*"', r"(?:u8|[uUL])?'(?:[^'\\\n]|\\[^\n])+'",
            _NUMBER, _WORD, _OPS,
        ]
    ),
    "python": "|".join(
        [
            _SPACE, _CONFLICT, r"\#[^\n]*", r"\\\n",
            r'[rRbBuUfF]{0,2}"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', r"[rRbBuUfF]{0,2}'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''",
            r"[rRbBuUfF]{0,2}" + _DQ, r"[rRbBuUfF]{0,2}" + _SQ, _NUMBER, _WORD, _OPS,
        ]
    ),
}

FAMILY = {"typescript": "js", "tsx": "tsx", "javascript": "js", "go": "go", "rust": "rust", "cpp": "cpp", "python": "python"}


@lru_cache(maxsize=None)
def pattern(family: str) -> re.Pattern:
    return re.compile(f"(?:{_PATTERNS[family]})|[\\s\\S]")


def normal(text: str) -> str:
    """Text without byte order mark, with line feeds as the only line ends."""
    text = text.removeprefix("﻿")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def tokens(text: str, language: str) -> list[str]:
    return pattern(FAMILY[language]).findall(text)


def is_trivia(token: str, family: str) -> bool:
    """White space or a comment."""
    if token.isspace():
        return True
    if family == "python":
        return token[0] == "#" or token == "\\\n"
    return len(token) > 1 and token[0] == "/" and token[1] in "/*" and (token[1] == "/" or token.endswith("*/"))
