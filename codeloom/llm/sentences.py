"""Sentence boundaries across languages and scripts (problem 9).

A document is read block by block: fenced code blocks, heading lines and list items are units of
their own, blank lines end units, single line breaks do not. Prose goes through a lattice whose
nodes are the gaps at which a sentence may end, each with a cost; the cheapest path through it gives
the sentence ends.

* Spaced scripts: a terminator lattice. The cost of cutting at a gap depends on the word with the
  terminator (abbreviation, ordinal, initial), on the word that follows, and on open quotations.
* Spaceless scripts (Chinese, Japanese): every run is segmented by a lattice of dictionary words
  (the least cost over words and single characters). Gaps stand behind terminators, and between a
  particle or polite ending that closes a sentence and a word that opens one, with or without a
  terminator; final particle and opening word set the cost. In Thai a blank between two Thai
  characters ends a sentence.

The dictionary holds the words listed here and the words of two or more characters of the vocabulary
file ``LEXICON`` (a parameter). Every worker needs the file: where it is missing, damaged or without
such words, a text with a spaceless run is an error, as other words would give other units. Khmer and
Burmese are cut at their terminators only, Lao and Tibetan at blank lines only.

Defined results: null, empty and blank texts have no units; a unit ends with its last non-blank
character; a fence that is never closed runs to the end of the text; equal rows give equal units.
Input columns keep their names; ``units`` is an array of (sent_start, sent_end) in code points.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_BULLET = re.compile(r"[ \t]*[-*+•‣◦][ \t]+\S")
_NUMBERED = re.compile(r"[ \t]*(\d{1,9})[.)][ \t]+\S")
_RULE = re.compile(r"[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:=[ \t]*){3,})$")

# Abbreviations that a word always follows.
_JOINING = frozenset(
    """approx. cf. e.g. i.e. vs. fig. figs. sec. ch. chap. rel. eq. ref. vol. ed. eds. pp. p. n. no. nos. mr. mrs. ms. dr.
    prof. st. gen. rev. gov. sen. inc. ltd. co. corp. dept. est. min. max. avg. resp. viz. al. ca. bzw. abs. nr. vgl. evtl.
    ggf. inkl. exkl. zzgl. bspw. hr. fr. str. tel. art. anm. aufl. hrsg. sog. allg. pág. págs. pag. aprox. núm. sr. sra. srta.
    ud. uds. dra. cap. ref. c.-à-d. env. mme. mlle. mgr. chap. éd. fasc. ок. тыс. млн. млрд. см. рис. табл. гл. стр. ср. др.
    напр. им. ул. г. п. с. т. м. l'art. d'env. z.b. d.h. u.a. o.ä. u.ä. i.d.r. v.a. p.ej. ee.uu. т.е. т.к. т.н.""".split()
)
# Abbreviations that may end a sentence; the next word decides.
_ENDING = frozenset("""etc. a.m. p.m. usw. ff. u.s. u.k. jr. sr.. inc. ltd. co. corp. d.c. т.д. т.п. др. i.e.. al. bros.""".split())
# Words before an ordinal number.
_BEFORE_ORDINAL = frozenset("am ab dem den der des die das im vom zum zur bis seit jeden jedem jeder ihrem seinem diesem beim pro je und nach vor in".split())
# Dictionary of the word lattices; words that carry on the sentence after a quotation, and words that end or open one.
_CARRY_ON = frozenset(
    """他写道 她写道 他说 她说 他问 她问 他们说 我说 我问 有人说 有人问 他说道 她说道 他喊道 他回答 她回答 他补充 他表示 写道 说道 问道 喊道 表示 说 的 之 是 等 这 地 得 了
    と って という といった との とある とは とか なんて は が を に の も で や へ から まで より など だ です である""".split()
)
_FINALS = frozenset("吗 呢 吧 啊 呀 です ます でした ました ません ですか ますか でしたか ましたか ませんか だよ だね ですね ますね ですよ ますよ".split())
# Endings that close a sentence before a terminator, but not by themselves.
_WEAK_FINALS = frozenset("了 的 か ね よ だ た ない".split())
_OPENERS = frozenset(
    """为什么 请 请先 没有 版本 比例 报告 但是 因此 如果 然后 我们 我 你 他们 不过 所以 今天 现在 这 那 なぜ まず しかし また そして 報告書 比率 もし だから それ これ 私 今日""".split()
)
#: Public vocabulary whose words enter the dictionary.
LEXICON = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def dictionary(path: str, own: frozenset) -> tuple[dict[str, float], int]:
    """Costs of the dictionary's words, and the length of the longest. A listed word costs 1, a word
    of the vocabulary 1.2, a single character that is no word 1.1. Raises an error where the file is
    missing, a line is not a word with its rank, or none is a word of a spaceless script."""
    costs = {}
    with open(path, "rb") as lines:
        for number, line in enumerate(lines, 1):
            if not line.strip():
                continue
            try:
                token, rank = line.split()
                entry, _ = base64.b64decode(token, validate=True), int(rank)
            except ValueError as error:
                raise ValueError(f"{path}, line {number}: not a word and its rank") from error
            try:
                word = entry.decode()
            except UnicodeDecodeError:  # a part of a character, which is a token but no word
                continue
            if len(word) > 1 and _RUN.fullmatch(word):
                costs[word] = 1.2
    if not costs:
        raise ValueError(f"{path}: no words of spaceless scripts")
    costs.update(dict.fromkeys(own, 1.0))
    return costs, max(map(len, costs))


_RUN = re.compile(r"[\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f]+")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_TERMINATOR = re.compile(r"[.!?…。！？｡।॥؟۔។៕။]+|(?<=[฀-๿])[ \t ]+(?=[฀-๿])")
_PAIRS = {"(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "「": "」", "『": "』", "«": "»", "„": "“", "“": "”", "‹": "›", "‚": "‘"}
_CLOSERS = frozenset(")]）】》」』»”\"›’'“*_")
_FULL = frozenset("。！？｡")


@lru_cache(maxsize=20_000)
def word_lattice(text: str, own: frozenset | None = None) -> tuple[str, ...]:
    """Cheapest segmentation of a run into words of the dictionary and single characters."""
    costs, longest = dictionary(LEXICON, _CARRY_ON | _FINALS | _OPENERS if own is None else own)
    n = len(text)
    best, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for i in range(n):
        base = best[i] + 1.1
        if base < best[i + 1]:
            best[i + 1], back[i + 1] = base, i
        for j in range(i + 1, min(n, i + longest) + 1):
            cost = costs.get(text[i:j])
            if cost is not None and best[i] + cost < best[j]:
                best[j], back[j] = best[i] + cost, i
    words, j = [], n
    while j:
        words.append(text[back[j] : j])
        j = back[j]
    return tuple(reversed(words))


def _quotes(text: str) -> list[tuple[int, int]]:
    """Matched pairs of quotation marks and brackets; marks without a partner are ignored."""
    pairs: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {c: [] for c in (*_PAIRS, '"')}  # places in the stack by mark

    def close(openers: str, at: int) -> bool:
        opened = max((places[c][-1] for c in openers if places[c]), default=None)
        if opened is None:
            return False
        pairs.append((stack[opened][1], at))
        while len(stack) > opened:
            places[stack.pop()[0]].pop()
        return True

    for m in _MARKS.finditer(text):
        c, at = m[0], m.start()
        if c == '"':
            opens = at and text[at - 1].isspace() and at + 1 < len(text) and not text[at + 1].isspace()
            if not opens and close('"', at):
                continue
        elif c in _OPENERS_OF and close(_OPENERS_OF[c], at):
            continue
        if c == '"' or c in _PAIRS:
            places[c].append(len(stack))
            stack.append((c, at))
    return pairs


_MARKS = re.compile(r"[()\[\]（）【】《》「」『』«»„“”‹›‚‘\"]")
_OPENERS_OF: dict[str, str] = {}
for _open, _close in _PAIRS.items():
    _OPENERS_OF[_close] = _OPENERS_OF.get(_close, "") + _open
_OPENERS_OF["”"] = _OPENERS_OF.get("”", "") + "„"


class _Runs:
    """Words of the spaceless runs of a text by the places where they start and end."""

    def __init__(self, text: str):
        own = _CARRY_ON | _FINALS | _OPENERS
        self.starts: dict[int, str] = {}
        self.ends: dict[int, str] = {}
        #: Places between a closing and an opening word that no terminator marks.
        self.between: list[int] = []
        for m in _RUN.finditer(text):
            at, last = m.start(), ""
            for word in word_lattice(m[0], own):
                if last in _FINALS and word in _OPENERS:
                    self.between.append(at)
                self.starts[at] = word
                at += len(word)
                self.ends[at] = last = word

    def cost(self, text: str, start: int, after: int, quoted: bool) -> float:
        """Cost of a gap between the words before place ``start`` and at place ``after``."""
        before, behind = self.ends.get(start, ""), self.starts.get(after)
        cost = (0.2 if quoted else -1.0) - (0.3 if before in _FINALS or before in _WEAK_FINALS else 0.0)
        if behind in _CARRY_ON:
            return cost + (1.6 if quoted else 0.2)
        return cost - (0.6 if behind in _OPENERS or text[after] in _PAIRS else 0.4)


_CODE_WORD = re.compile(r"`|[A-Za-z$][\w$]*(?:_\w|[a-z][A-Z]|\(\)|\.\w+\()|[a-z][\w-]*\.(?:[a-z]{1,4}|\w+\(\))(?=\s)|v?\d")
_SPACES = re.compile(r"\s*")
_CLOSING_BLANK = re.compile(r"[   ]+(?=[»])")
_WORD_START = re.compile(r"[\"'“„«‹(\[¿¡`*_]*")
_INITIALS = re.compile(r"\S\.")


_BLANK = re.compile(r"\s")


class _Blanks:
    """Places of white space, for the words before a gap."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def at(self) -> list[int]:
        return [m.start() for m in _BLANK.finditer(self.text)]

    def word(self, end: int) -> tuple[int, str]:
        """Start and text of the word that ends at a place."""
        k = bisect_right(self.at, end - 1) - 1
        start = self.at[k] + 1 if k >= 0 else 0
        return start, self.text[start:end]

    def word_before(self, end: int) -> str:
        while end and self.text[end - 1].isspace():
            end -= 1
        return self.word(end)[1]


def _cut_cost(text: str, start: int, end: int, mark: str, blanks: _Blanks, runs: _Runs) -> float:
    """Cost of cutting at a gap; below 0 it is cheaper to cut. ``start`` is the terminator's place,
    ``end`` the place behind it and its closing marks, both in ``text``."""
    at = _SPACES.match(text, end).end()
    if at == len(text):
        return -1.0
    spaced = at > end
    quoted = any(c in "”」』»\"“" for c in text[start:end])
    if mark[-1] in _FULL:
        return runs.cost(text, start, at, quoted)
    if mark.isspace() or mark[-1] in "។៕။":
        return -1.0
    if not spaced:
        return runs.cost(text, start, at, True) if quoted and _SPACELESS.match(text, at) else 1.0
    first = text[at]
    opener = _WORD_START.match(text, at)[0]
    lead = text[at + len(opener) : at + len(opener) + 1] or first
    if first in "–—-…,;:)]}»”":
        return 1.0
    if mark[-1] in "।॥؟۔":
        return -1.0
    lower = lead.islower()
    code = bool(_CODE_WORD.match(text, at))
    if mark[-1] in "!?":
        return 1.0 if lower and not code and not opener.strip("*_") else -1.0
    if mark in ("...", "…", "....", ". . ."):
        return 1.0 if lower and not code else -1.0
    begin, word = blanks.word(start)
    word = word.lstrip("\"'“„«(‹[¿¡`*_") + "."
    small = word.lower()
    if end > start + len(mark):  # closing marks stand between the full stop and the gap
        return 1.0 if lower and not code else -1.0
    previous = blanks.word_before(begin).lower()
    if small in _ENDING and not (small in ("inc.", "ltd.", "co.", "corp.") and lower):
        if lead.isdigit() or (lower and not code):
            return 1.0
        return -0.5
    if small == "no." or small == "nos.":
        return 1.0 if lead.isdigit() else -1.0
    if small in _JOINING:
        return 1.0
    if len(word) == 2 and word[0].isalpha():
        if small == "д." and previous == "т.":
            return 1.0 if lower else -0.5
        if word[0] == "I" or (not word[0].isupper() and not lead.isdigit() and not lower and previous not in _JOINING and not _INITIALS.match(text, at)):
            return 1.0 if lower else -0.5
        return 1.0
    if re.fullmatch(r"(?:[^\W\d_]\.){2,}", word):
        return 1.0 if lower or lead.isdigit() else 0.5
    if word[:-1].isdigit() and len(word) <= 4 and previous in _BEFORE_ORDINAL and lead.isupper():
        return 1.0
    if lower and not code:
        return 1.0
    return -1.0


def split_prose(text: str) -> list[int]:
    """Ends of the sentences of a paragraph (offsets behind their last non-blank character)."""
    whole = len(text.rstrip())
    if not whole:
        return []
    closing = {b: a for a, b in _quotes(text)}
    # Depth of quotation at every place where it changes; looked up by bisection.
    turns, depths, depth = [], [], 0
    for place, step in sorted([(a + 1, 1) for a in closing.values()] + [(b + 1, -1) for b in closing]):
        depth += step
        turns.append(place)
        depths.append(depth)

    def quoted(place: int) -> bool:
        k = bisect_right(turns, place) - 1
        return k >= 0 and depths[k] > 0

    blanks, runs = _Blanks(text), _Runs(text)
    # A particle that closes and a word that opens: 1.2 against a gap without terminator, less 0.8 for each.
    gaps: list[tuple[int, float]] = [(at, -0.4) for at in runs.between if not quoted(at)]
    for m in _TERMINATOR.finditer(text, 0, whole):
        mark, start = m[0], m.start()
        end = m.end()
        if mark.isspace():
            if not quoted(start):
                gaps.append((start, _cut_cost(text, start, start, mark, blanks, runs)))
            continue
        if mark == "." and start and end < len(text) and text[end : end + 1].isalnum():
            continue
        while end < whole and text[end] in _CLOSERS and (text[end] in "*_’'" or closing.get(end, start) < start):
            end += 1
        if end >= whole:
            continue
        # A French terminator stands behind a blank; a closing mark may follow a blank too.
        gap = _CLOSING_BLANK.match(text, end)
        if gap and closing.get(gap.end(), start) < start:
            end = gap.end() + 1
        if end >= whole or quoted(end):
            continue
        gaps.append((end, _cut_cost(text, start, end, mark, blanks, runs)))
    return _cheapest_path(text, sorted(gaps), whole)


def _cheapest_path(text: str, gaps: list[tuple[int, float]], whole: int) -> list[int]:
    """Ends of the units on the cheapest path from the start over some of the gaps to the end.

    A path costs the sum of its gaps; a step without a letter or digit is not allowed. The best
    path to a gap comes from the best gap before the last letter or digit in front of it.
    """
    last, scanned = -1, 0  # the last letter or digit before the gap, and how far was looked
    best: list[tuple[float, int]] = []  # cost of the best path that ends at the gap, gap before it
    ready, source, least = 0, -1, 0.0  # gaps that a step may come from, the cheapest of them
    nodes = [*gaps, (whole, 0.0)]
    for k, (at, cost) in enumerate(nodes):
        last = next((p for p in range(at - 1, scanned - 1, -1) if text[p].isalnum()), last)
        scanned = max(scanned, at)
        while ready < k and nodes[ready][0] <= last:
            if best[ready][0] < least:
                least, source = best[ready][0], ready
            ready += 1
        best.append((least + cost if last >= 0 or k == len(gaps) else float("inf"), source))
    ends, k = [whole], best[-1][1]
    while k >= 0:
        ends.append(nodes[k][0])
        k = best[k][1]
    return ends[::-1]


def split_text(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of all units of a text, in code points."""
    if not text or not text.strip():
        return []
    units: list[tuple[int, int]] = []
    para: list[int] = []  # start and end of the open paragraph
    item: list[int] = []  # start and end of the open list item
    number: int | None = None  # number of the open list item; -1 for a bullet
    fence: tuple[str, int] | None = None
    at = 0

    def close() -> None:
        nonlocal para, item
        if item:
            units.append((item[0], item[1]))
        if para:
            begin = para[0]
            for end in split_prose(text[para[0] : para[1]]):
                stop = para[0] + end
                while begin < stop and text[begin].isspace():
                    begin += 1
                units.append((begin, stop))
                begin = stop
        para, item = [], []

    for line in text.split("\n"):
        start, stop = at, at + len(line.rstrip())
        at += len(line) + 1
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0][0] and len(m[1]) >= len(fence[0]) and not line.strip().strip(m[1][0]):
                units.append((fence[1], stop))
                fence = None
            continue
        if not line.strip():
            close()
            number = None
            continue
        start += len(line) - len(line.lstrip())
        opened = _FENCE.match(line)
        if opened:
            close()
            number, fence = None, (opened[1], start)
            continue
        if _HEADING.match(line) or _RULE.match(line):
            close()
            number = None
            if any(c.isalnum() for c in line) or line.lstrip().startswith("#"):
                units.append((start, stop))
            continue
        numbered, bullet = _NUMBERED.match(line), _BULLET.match(line)
        begins = bool(bullet) or bool(
            numbered and not para and (number is None or number == -1 or int(numbered[1]) == number + 1 or not item)
        )
        if begins:
            close()
            number = int(numbered[1]) if numbered else -1
            item = [start, stop]
        elif item:
            item[1] = stop
        elif para:
            para[1] = stop
        else:
            para = [start, stop]
    if fence:
        units.append((fence[1], len(text.rstrip())))
    close()
    return sorted(units)


UNITS = "array<struct<sent_start:int, sent_end:int>>"


def segment(documents: DataFrame, text: str = "text") -> DataFrame:
    """Input plus ``units``. Map-only."""

    @F.pandas_udf(UNITS)
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"sent_start": a, "sent_end": b} for a, b in split_text(t)] for t in texts])

    return documents.withColumn("units", split(F.col(text)))


def boundaries(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit_no, sent_start, sent_end), one row per unit. Map-only; a text is read once and only
    offsets come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, k, a, b) for key, text in zip(batch["id"], batch["text"], strict=True) for k, (a, b) in enumerate(split_text(text))]
            yield pd.DataFrame(rows, columns=["id", "unit_no", "sent_start", "sent_end"])

    named = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return named.mapInPandas(run, "id long, unit_no int, sent_start int, sent_end int").withColumnRenamed("id", id_col)


def sentences(documents: DataFrame) -> DataFrame:
    """One row per unit with its text; rows repeated whole count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, k, a, b, text[a:b]) for key, text in zip(batch["doc_id"], batch["text"], strict=True) for k, (a, b) in enumerate(split_text(text))]
            yield pd.DataFrame(rows, columns=["doc_id", "unit_no", "sent_start", "sent_end", "sentence"])

    once = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").distinct()
    return once.mapInPandas(run, "doc_id long, unit_no int, sent_start int, sent_end int, sentence string")
