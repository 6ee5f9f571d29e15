"""Splitting oversized items at natural boundaries (problem 6) by ranges with halos.

A text (a table cell or a giant file) is never walked from its start. It is divided into ranges;
a worker reads one range with a halo on both sides and lists its boundaries: line ends, and blanks
within overlong lines, each with a score (a blank line before a line of little indentation is
best). Each stretch between boundaries weighs what it takes of the limit, the larger of its share
of the lines and of the characters, so stretches of total weight 1 fit both limits. Sums per range
are stitched by a prefix sum, which gives every boundary its place in the whole text; the j-th cut
is the best boundary of total weight within ``STEP * j - SLACK .. STEP * j``. Cuts do not depend on
each other, so ranges are worked on independently; pieces are emitted by offset.

A piece starts ``overlap`` lines before its cut. STEP + SLACK + OVERLAP is 1, so every piece,
overlap included, stays within both limits; lines too long for the overlap's share are left out of
it (then fewer lines are shared).

Defined results: null texts have no pieces; a text within the limits, an empty one included, is one
piece; repeated rows of an id and text count once; several texts of one id are cut separately;
``start_line`` and ``end_line`` are null where the item's start line is null. A text without any
blank is cut after ``LONGEST`` characters. Column names of the input other than those named are
free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

MAX_LINES, MAX_CHARS, OVERLAP_LINES = 150, 8_000, 20
STEP, SLACK, OVERLAP = 0.6, 0.2, 0.2
#: Stretches are at most this share of the character limit, so that each window holds a boundary.
LONGEST_SHARE = 0.125
#: Characters (table cells) or bytes (files) of one range.
RANGE_CHARS, RANGE_BYTES = 16_384, 4 << 20

_INDENT = re.compile(r"[ \t]*")


def _stretches(core: str, longest: int) -> list[tuple[int, bool]]:
    """(end, at a line end) of the stretches of a range."""
    out, at = [], 0
    lines = core.split("\n")  # a line ends with a line feed and nothing else
    for line in [*(x + "\n" for x in lines[:-1]), lines[-1]]:
        end = at + len(line)
        while end - at > longest:
            window = core[at : at + longest]
            cut = max(window.rfind(" "), window.rfind("\t")) + 1
            at += cut if cut > longest // 4 else longest
            out.append((at, False))
        if end > at:
            out.append((end, line.endswith("\n")))
        at = end
    return out


def boundaries(core: str, left: str, right: str, max_lines: int, max_chars: int, overlap_lines: int) -> tuple[np.ndarray, ...]:
    """Boundary table of a range: end offsets in ``core``, weights of the stretches, line feeds,
    scores, and how many characters and lines of overlap reach back from each boundary."""
    longest = max(1, int(max_chars * LONGEST_SHARE))
    ends, weights, feeds, scores, back, back_lines = [], [], [], [], [], []
    context = left + core
    base = len(left)
    starts = [0] + [m.end() for m in re.finditer(r"\n", context)]
    line_no = 0
    most = int(OVERLAP * max_chars)
    most_lines = min(overlap_lines, int(OVERLAP * (max_lines - 1)))
    begin = 0
    reach = context + right
    for end, at_line_end in _stretches(core, longest):
        size = end - begin
        ends.append(end)
        feeds.append(1 if at_line_end else 0)
        weights.append(max(1 / max(1, max_lines - 1), size / max_chars))
        place = base + end
        if at_line_end:
            indent = len(_INDENT.match(reach, place)[0].expandtabs(4))
            following = reach[place + len(_INDENT.match(reach, place)[0]) : place + len(_INDENT.match(reach, place)[0]) + 1]
            blank_before = not context[context.rfind("\n", 0, place - 1) + 1 : place].strip()
            score = 1000 - min(indent, 99) * 4 + (300 if blank_before else 0)
            if following in ("\n", "\r", ""):
                score -= 150  # better behind the blank line than before it
            elif following in ")]}":
                score -= 350  # a closing bracket belongs to the lines before
        else:
            score = 100 if end < len(core) and core[end - 1].isspace() else 0
        scores.append(score)
        while line_no + 1 < len(starts) and starts[line_no + 1] < place:
            line_no += 1
        # Lines that may be shared: whole lines before the boundary, as many as fit.
        shared, reach_back = 0, 0
        k = line_no
        while k >= 0 and shared < most_lines:
            if starts[k] == 0 and k == 0 and left and place - starts[k] > 0 and not left.startswith("\x00"):
                break  # this line starts before the halo
            length = place - starts[k]
            if length > most:
                break
            shared, reach_back = shared + 1, length
            k -= 1
        back.append(reach_back)
        back_lines.append(shared)
        begin = end
    return (
        np.array(ends, np.int64),
        np.array(weights, np.float64),
        np.array(feeds, np.int32),
        np.array(scores, np.int32),
        np.array(back, np.int32),
        np.array(back_lines, np.int32),
    )


BOUNDARY_TABLE = "item string, part long, lo long, weight double, feeds long, size long, ends binary, weights binary, line_feeds binary, scores binary, back binary, back_lines binary"


def _row(item: str, part: int, lo: int, size: int, found: tuple[np.ndarray, ...]) -> tuple:
    ends, weights, feeds, scores, back, back_lines = found
    return (item, part, lo, float(weights.sum()), int(feeds.sum()), size, *(x.tobytes() for x in (ends, weights, feeds, scores, back, back_lines)))


_COLUMNS = [c.split()[0] for c in BOUNDARY_TABLE.split(", ")]


def stitch(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(best cut per item and window, totals per item) from the boundary tables of all ranges.

    Only the sums of the ranges are gathered per item, one small row per range.
    """
    # Kept, so that ranges are read twice and not once per use of the sums.
    sums = cut_lineage(table.select("item", "part", "weight", "feeds", "size"))
    before = Window.partitionBy("item").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "item",
        "part",
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.coalesce(F.sum("feeds").over(before), F.lit(0)).cast("long").alias("feeds_before"),
    )
    totals = sums.groupBy("item").agg(F.sum("weight").alias("weight"), F.sum("feeds").alias("feeds"), F.sum("size").alias("size"))
    # Behind the cut of the last window at most STEP + SLACK are left: with the overlap that is within 1.
    last = F.greatest(F.ceil((F.col("weight") - (1 - OVERLAP - SLACK)) / STEP), F.lit(1)).cast("long")
    totals = totals.withColumn("cuts", last)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                ends, weights = np.frombuffer(r.ends, np.int64), np.frombuffer(r.weights, np.float64)
                if not len(ends):
                    continue
                upto = r.weight_before + np.cumsum(weights)
                ended = np.frombuffer(r.line_feeds, np.int32)
                feeds = r.feeds_before + np.cumsum(ended)
                scores, back, lines = np.frombuffer(r.scores, np.int32), np.frombuffer(r.back, np.int32), np.frombuffer(r.back_lines, np.int32)
                window = np.ceil(upto / STEP - 1e-9).astype(np.int64)
                inside = (upto > window * STEP - SLACK) & (window <= r.cuts) & (window >= 1)
                best: dict[int, int] = {}
                for k in np.flatnonzero(inside).tolist():
                    j = int(window[k])
                    if j not in best or scores[k] >= scores[best[j]]:
                        best[j] = k
                for j, k in best.items():
                    out.append((r.item, j, int(scores[k]), r.lo + int(ends[k]), int(feeds[k]), int(back[k]), int(lines[k]), int(ended[k])))
            yield pd.DataFrame(out, columns=["item", "window", "score", "cut", "line", "back", "back_lines", "ended"])

    placed = table.join(offsets, ["item", "part"]).join(totals.select("item", "cuts"), "item")
    found = placed.mapInPandas(choose, "item string, window long, score int, cut long, line long, back int, back_lines int, ended int")
    best = found.groupBy("item", "window").agg(F.max(F.struct("score", "cut", "line", "back", "back_lines", "ended")).alias("b"))
    return best.select("item", "window", "b.cut", "b.line", "b.back", "b.back_lines", "b.ended"), totals


def plan(table: DataFrame) -> DataFrame:
    """(item, piece_no, start, end, first_line, last_line, shared_lines): pieces by offset, 0-based
    numbers, 1-based lines, end exclusive."""
    cuts, totals = stitch(table)
    inner = cuts.join(totals.select("item", "size"), "item").where("cut < size")
    zero = totals.select(
        "item", F.lit(0).cast("long").alias("window"), F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("line"), F.lit(0).alias("back"), F.lit(0).alias("back_lines"), F.lit(0).alias("ended")
    )
    order = Window.partitionBy("item").orderBy("window")
    every = zero.unionByName(inner.drop("size")).join(totals.select("item", "size", "feeds"), "item")
    after = F.lead("cut").over(order)
    # A cut inside a line leaves its line on both sides.
    line_after = F.lead(F.col("line") + 1 - F.col("ended")).over(order)
    return every.select(
        "item",
        (F.row_number().over(order) - 1).alias("piece_no"),
        (F.col("cut") - F.col("back")).alias("start"),
        F.coalesce(after, F.col("size")).alias("end"),
        # The line of a cut inside a line is itself among the shared ones.
        (F.col("line") - F.col("back_lines") + 1 + F.when((F.col("ended") == 0) & (F.col("back_lines") > 0), 1).otherwise(0)).alias("first_line"),
        F.coalesce(line_after, F.col("feeds") + 1).alias("last_line"),
        F.col("back_lines").alias("shared_lines"),
    )


def oversized(rows: DataFrame, text: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS):
    """Condition: more lines (line feeds + 1) or characters than allowed. Native."""
    body = F.col(text)
    return (F.length(body) > max_chars) | (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1 > max_lines)


def cell_boundaries(
    items: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_LINES, range_chars: int = RANGE_CHARS
) -> DataFrame:
    """Boundary tables of the texts of ``items`` (item, text), range by range. A text is read once; its
    ranges come out in order, so the time is linear in its length."""
    halo = 2 * max_chars // 5 + 64

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"], strict=True):
                for part, lo in enumerate(range(0, max(1, len(text)), range_chars)):
                    core = text[lo : lo + range_chars]
                    left = ("\x00" if lo and lo <= halo else "") + text[max(0, lo - halo) : lo]
                    found = boundaries(core, left, text[lo + range_chars : lo + range_chars + 256], max_lines, max_chars, overlap)
                    rows.append(_row(item, part, lo, len(core), found))
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return items.select("item", "text").mapInPandas(read, BOUNDARY_TABLE)


def split_cells(
    rows: DataFrame, id_col: str, text_col: str, start_line: str | None = None, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP_LINES, range_chars: int = RANGE_CHARS, with_text: bool = True,
) -> DataFrame:
    """Pieces of the oversized texts of a table."""
    line = F.col(start_line).cast("long") if start_line else F.lit(None).cast("long")
    items = (
        rows.where(F.col(text_col).isNotNull() & oversized(rows, text_col, max_lines, max_chars))
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), line.alias("begins"))
        .groupBy("id", "text")
        .agg(F.min("begins").alias("begins"))
        .withColumn("item", F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), F.hex(F.xxhash64("text"))))
    )
    pieces = plan(cell_boundaries(items.select("item", "text"), max_lines, max_chars, overlap, range_chars))
    source = items if with_text else items.drop("text")
    joined = pieces.join(source, "item")
    columns = [
        F.col("id").alias(id_col),
        "piece_no",
        F.col("start").alias("char_start"),
        F.col("end").alias("char_end"),
        (F.col("begins") + F.col("first_line") - 1).alias("start_line"),
        (F.col("begins") + F.col("last_line") - 1).alias("end_line"),
        "first_line",
        "last_line",
        "shared_lines",
    ]
    if with_text:
        columns.append(F.expr("substring(text, cast(start as int) + 1, cast(end - start as int))").alias("piece"))
    return joined.select(*columns)


# --- giant files ----------------------------------------------------------------------------------


def _read_bytes(uri: str, at: int, size: int) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as source:
        return source.read_at(size, at)


def _aligned(data: bytes, at: int) -> int:
    """First character start at or behind ``at``."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def split_files(
    spark: SparkSession, files: list[tuple[str, int]], max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_LINES,
    range_bytes: int = RANGE_BYTES, with_text: bool = True,
) -> DataFrame:
    """Pieces of files given as (URI, size in bytes); offsets are bytes. No task reads more than a
    range and its halos, or one piece. The character limit is applied to bytes, which is stricter."""
    halo = 4 * max_chars // 5 + 64
    listed = spark.createDataFrame(files, "item string, bytes long")
    count = F.greatest(F.ceil(F.col("bytes") / range_bytes), F.lit(1))
    parts = listed.select("item", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("part")).repartition(
        max(1, min(10_000, sum(size // range_bytes + 1 for _, size in files)))
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                lo, hi = r.part * range_bytes, min((r.part + 1) * range_bytes, r.bytes)
                first = max(0, lo - halo)
                data = _read_bytes(r.item, first, min(r.bytes, hi + 260) - first)
                a, b = _aligned(data, lo - first), _aligned(data, hi - first)
                # Latin-1 keeps one character per byte; line feeds, blanks and brackets are ASCII.
                core, left = data[a:b].decode("latin-1"), data[_aligned(data, 0) : a].decode("latin-1")
                left = ("\x00" + left if first == 0 and left else left)
                ends, *rest = boundaries(core, left, data[b : b + 256].decode("latin-1"), max_lines, max_chars, overlap)
                # A cut inside a line may not divide a character.
                raw = data[a:b]
                ends = np.array([_aligned(raw, int(e)) for e in ends], np.int64)
                yield pd.DataFrame([_row(r.item, r.part, first + a, b - a, (ends, *rest))], columns=_COLUMNS)

    pieces = plan(parts.mapInPandas(read, BOUNDARY_TABLE))
    if not with_text:
        return pieces

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [_read_bytes(i, s, e - s).decode("utf-8", "replace") for i, s, e in zip(batch["item"], batch["start"], batch["end"], strict=True)]
            yield batch.assign(piece=texts)

    kind = "item string, piece_no int, start long, end long, first_line long, last_line long, shared_lines int, piece string"
    return pieces.mapInPandas(load, kind)
