"""Evaluation texts leaking into training text (problem 7).

The passages of held-out items are cut into runs of ``n`` words; a hash set of the runs goes to
every task, which scans the word windows of its texts, verifies each hit word by word, and names
the items. Matching spans can be removed, or documents dropped whose spans cover too much.

The set of items is read in slices of at most ``SLICE_BYTES`` of text, one pass each, so that what
is broadcast is bounded whatever the size of the evaluation set.

Defined results: a word is a maximal run of letters or digits, case ignored. Null texts, prompts
and solutions hold no words; a passage never runs from the prompt into the solution; passages and
texts of fewer than ``n`` words match nothing; an item that shares a passage with others is named
beside them; repeated rows give one result. Columns other than those named are passed through by
``scan`` and may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_IN_RUN = 12
SLICE_BYTES = 8 << 20

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words of a text in lower case; a letter whose lower case is longer stays one letter of its word."""
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


class Passages:
    """Runs of words of the items: vocabulary, words as numbers, and hashes of the runs with the place
    of each. For a slice of b bytes of text at most b / 2 words: 30 bytes each, and the vocabulary."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], n: int):
        self.n, self.vocabulary = n, {}
        codes, owners = [], []
        for item, *texts in items:
            for text in texts:
                own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
                codes += [*own, 0]  # no run goes from one text into the next
                owners += [item] * (len(own) + 1)
        self.codes, self.owners = np.array(codes, np.uint32), np.array(owners, np.int64)
        at = self._whole(self.codes)
        found = self._hash([self.codes[at + k] for k in range(n)])
        order = np.argsort(found, kind="stable")
        self.hashes, self.at = found[order], at[order].astype(np.uint32)

    def _whole(self, word: np.ndarray) -> np.ndarray:
        """Places of the runs that hold no foreign word."""
        if len(word) < self.n:
            return np.empty(0, np.int64)
        foreign = np.concatenate([[0], np.cumsum(word == 0)])
        return np.flatnonzero(foreign[self.n :] == foreign[: len(foreign) - self.n])

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            out = (out ^ (out >> np.uint64(29))) * _BASE + column
        return out

    def hits(self, texts: list[str | None]) -> list[list[tuple[int, tuple[int, ...]]]]:
        """Per text the verified windows: (number of the first word, items)."""
        codes, starts, get = [], [], self.vocabulary.get
        for text in texts:
            starts.append(len(codes))
            codes += [get(w, 0) for w in words_of(text)]
            codes.append(0)  # a word of no item keeps windows within their text
        starts.append(len(codes))
        out: list[list] = [[] for _ in texts]
        word = np.array(codes, np.uint32)
        whole = self._whole(word)
        if not len(whole) or not len(self.hashes):
            return out
        found = self._hash([word[whole + k] for k in range(self.n)])
        low, high = np.searchsorted(self.hashes, found), np.searchsorted(self.hashes, found, side="right")
        met = np.flatnonzero(high > low)
        owner = np.searchsorted(np.array(starts), whole[met], side="right") - 1
        span = np.arange(self.n)
        for text, place, a, b in zip(owner.tolist(), whole[met].tolist(), low[met].tolist(), high[met].tolist(), strict=True):
            at = self.at[a:b].astype(np.int64)
            same = (self.codes[at[:, None] + span] == word[place : place + self.n]).all(axis=1)
            if same.any():
                out[text].append((place - starts[text], tuple(np.unique(self.owners[at[same]]).tolist())))
        return out


def _slices(items: DataFrame, budget: int) -> Iterator[list[tuple[int, str | None, str | None]]]:
    rows, size = [], 0
    wanted = items.select(F.col("item_id").cast("long"), "prompt", "solution").where("item_id IS NOT NULL")
    for row in wanted.distinct().toLocalIterator():
        rows.append(tuple(row))
        size += len(row[1] or "") + len(row[2] or "")
        if size > budget:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def scan(documents: DataFrame, items: DataFrame, n: int = WORDS_IN_RUN, budget: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, text_hash): verified spans of documents, ends
    exclusive; the hash tells texts of one id apart.

    Map-only over the documents, once per slice of the evaluation set.
    """
    spark = documents.sparkSession
    kind = "doc_id long, item_id long, start_word int, end_word int, text_hash long"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    out = spark.createDataFrame([], kind)
    for rows in _slices(items, budget):
        shared = spark.sparkContext.broadcast(Passages(rows, n))

        def look(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            passages = shared.value
            for batch in batches:
                found = []
                for doc, mark, hits in zip(batch["doc_id"].to_numpy(), batch["text_hash"].to_numpy(), passages.hits(batch["text"].tolist()), strict=True):
                    open_spans: dict[int, list[int]] = {}
                    for place, owners in hits:
                        for item in owners:
                            span = open_spans.get(item)
                            if span and place <= span[1]:
                                span[1] = place + passages.n
                            else:
                                if span:
                                    found.append((doc, item, *span, mark))
                                open_spans[item] = [place, place + passages.n]
                    found += [(doc, item, *span, mark) for item, span in open_spans.items()]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start_word", "end_word", "text_hash"])

        out = out.unionByName(texts.mapInPandas(look, kind))
    return out


def report(spans: DataFrame) -> DataFrame:
    """Per item: how many documents hold a passage of it, and the longest passage in words."""
    return spans.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.max(F.col("end_word") - F.col("start_word")).cast("long").alias("longest_passage")
    )


def decontaminate(documents: DataFrame, spans: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """Documents without the leaked spans: (doc_id, text, removed_words, dropped).

    A document of which more than ``drop_share`` of the words leaked is dropped (text null).
    Documents without spans come through as they are.
    """
    marks = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start_word", "end_word")).alias("_cl_spans"))
    texts = documents.select("doc_id", "text").distinct().withColumn("text_hash", F.xxhash64("text"))

    @F.pandas_udf("struct<text:string, removed_words:int, dropped:boolean>")
    def cut(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for body, spans_of in zip(text, found, strict=True):
            if spans_of is None or len(spans_of) == 0 or body is None:
                rows.append((body, 0, False))
                continue
            words = list(_WORD.finditer(body))
            gone = np.zeros(len(words), bool)
            for s in spans_of:
                gone[s["start_word"] : s["end_word"]] = True
            if gone.mean() > drop_share:
                rows.append((None, int(gone.sum()), True))
                continue
            kept, at = [], 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                kept.append(body[at : words[a].start()])
                at = words[b - 1].end()
            kept.append(body[at:])
            rows.append(("".join(kept), int(gone.sum()), False))
        return pd.DataFrame(rows, columns=["text", "removed_words", "dropped"])

    joined = texts.join(marks, ["doc_id", "text_hash"], "left").withColumn("_cl_cut", cut("text", "_cl_spans"))
    return joined.select("doc_id", "_cl_cut.text", "_cl_cut.removed_words", "_cl_cut.dropped")
