"""Mixing sources to target weights (problem 8): weighted fair queueing.

Each document gets a place in a shuffled order of its source and a virtual finish time, the
tokens of its source up to and including it divided by the source's weight. A source that is
repeated runs through its order again with the time going on. All copies are put in the order of
their virtual finish time and truncated at the total budget, so every source has its share of any
prefix, up to one document.

Running sums never gather a source in one task: documents are split into blocks by their shuffle
hash, blocks are summed first, the few block sums per source are accumulated, and within a block
the sum starts at the block's offset. The same is done over the blocks of virtual time.

Defined results: sources are compared without case, outer blanks, and with blanks and hyphens as
underscores; documents of a source without a target, or with null id, are left out; null and empty
texts have no tokens and are left out; repeated rows of a document count once (of several texts of
one id the one with the smallest hash); a target that is null or not above zero, or a null or
non-positive cap, gives the source nothing. Several rows of one target source: the largest share
with its cap counts. Targets are normalised to sum 1 over the sources that have documents; a source
without any is reported with nothing reached. A source that has given all its copies is dry: the
others go on in their proportion until the budget is filled or all are dry, and the shares reached
are reported. An empty table gives an empty mix.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern that belongs to the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents per block, about.
BLOCK_ROWS = 50_000


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("mix", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Number of tokens of a text; null has none."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(tokenizer).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s\-]+", "_")


class Mix(NamedTuple):
    #: (doc_id, source, copy_no, tokens, finish_time), one row per copy that is taken.
    copies: DataFrame
    #: Target and reached shares per source.
    shares: DataFrame


def targets(weights: DataFrame) -> list[tuple[str, float, int]]:
    """(source, normalised share, cap) of the target sources; one row each, a small table by its nature."""
    usable = weights.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("cap"))
    best = usable.where("source IS NOT NULL AND share > 0 AND NOT isnan(share) AND cap > 0").groupBy("source").agg(F.max(F.struct("share", "cap")).alias("t"))
    rows = sorted((r["source"], r["t"]["share"], r["t"]["cap"]) for r in best.collect())
    everything = sum(share for _, share, _ in rows)
    return [(source, share / everything, cap) for source, share, cap in rows]


def mix(documents: DataFrame, weights: DataFrame, budget: int | None = None, tokenizer: str = TOKENIZER, seed: int = 17) -> Mix:
    """Chooses and repeats documents. Without ``budget`` the largest total is taken at which every
    source with a target can have its share within its cap."""
    spark = documents.sparkSession
    goal = targets(weights)
    goals = spark.createDataFrame(goal, "source string, share double, cap long")
    rows = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
        .where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND text <> ''")
        .join(F.broadcast(goals.select("source")), "source")
    )
    # Texts end here: their tokens are counted where they are read.
    counts = rows.select("doc_id", "source", F.xxhash64("text").alias("hash"), token_count(F.col("text"), tokenizer).alias("tokens"))
    counted = cut_lineage(
        counts.groupBy("doc_id")
        .agg(F.min(F.struct("hash", "tokens", "source")).alias("d"))
        .select("doc_id", "d.source", "d.tokens", F.xxhash64("doc_id", F.lit(seed)).alias("turn"))
        .where("tokens > 0")
    )
    totals = {
        r["source"]: (r["tokens"], r["rows"], r["longest"])
        for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.max("tokens").alias("longest")).collect()
    }
    filled = [(s, share, cap) for s, share, cap in goal if s in totals]
    if not filled:
        none = spark.createDataFrame([], "doc_id long, source string, copy_no int, tokens long, finish_time double")
        return Mix(none, _shares(none, goals, 0))
    whole = sum(share for _, share, _ in filled)
    filled = [(s, share / whole, cap) for s, share, cap in filled]
    if budget is None:
        budget = int(min(totals[s][0] * cap / share for s, share, cap in filled))
    documents_in = sum(r for _, r, _ in totals.values())
    blocks = max(1, documents_in // BLOCK_ROWS)

    # Running tokens within a source: block offsets, then sums within blocks.
    placed = counted.withColumn("block", F.floor((F.col("turn") / F.lit(2.0**64) + 0.5) * blocks))
    sums = placed.groupBy("source", "block").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "block").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.join(offsets, ["source", "block"]).select("doc_id", "source", "tokens", (F.col("offset") + F.sum("tokens").over(inside)).alias("upto"))

    until = last_time([(share, cap * totals[s][0]) for s, share, cap in filled], budget + sum(totals[s][2] for s, _, _ in filled)) * (1 + 1e-9)
    sized = spark.createDataFrame(
        [(s, share, min(cap, math.ceil(until * share / totals[s][0]) + 1), totals[s][0]) for s, share, cap in filled], "source string, share double, rounds long, total long"
    )
    finish = (F.col("k") * F.col("total") + F.col("upto")) / F.col("share")
    queue = (
        running.join(F.broadcast(sized), "source")
        .select("doc_id", "source", "tokens", "upto", "total", "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).alias("k"))
        .select("doc_id", "source", F.col("k").cast("int").alias("copy_no"), "tokens", finish.alias("finish_time"))
        .where(F.col("finish_time") <= until)
    )
    return _truncate(queue, goals, budget, until, max(1, 4 * documents_in // BLOCK_ROWS))


def last_time(sources: list[tuple[float, float]], tokens: float) -> float:
    """Virtual time until which (share, capacity) sources give so many tokens, dry ones their capacity
    only; the time at which the last is dry if that is less. No copy beyond the time for the budget
    and one document of each source can be among the first copies that fill the budget."""
    dry = sorted((capacity / share, share, capacity) for share, capacity in sources)
    given, rate = 0.0, sum(share for _, share, _ in dry)
    for time, share, capacity in dry:
        if given + rate * time >= tokens:
            return (tokens - given) / rate
        given, rate = given + capacity, rate - share
    return dry[-1][0] if dry else 0.0


def _truncate(queue: DataFrame, goals: DataFrame, budget: int, until: float, blocks: int) -> Mix:
    """Prefix of the queue in the order of finish times whose tokens fit the budget."""
    width = max(1.0, until / blocks)
    timed = queue.withColumn("slot", F.floor(F.col("finish_time") / width))
    sums = timed.groupBy("slot").agg(F.sum("tokens").alias("s"))
    # One row per block of time; their number follows the input, divided by BLOCK_ROWS.
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("slot", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset")).where(F.col("offset") <= budget)
    inside = Window.partitionBy("slot").orderBy("finish_time", "doc_id", "copy_no").rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        timed.join(offsets, "slot")
        .withColumn("reached", F.col("offset") + F.sum("tokens").over(inside))
        .where(F.col("reached") <= budget)
        .select("doc_id", "source", "copy_no", "tokens", "finish_time")
    )
    return Mix(taken, _shares(taken, goals, budget))


def _shares(taken: DataFrame, goals: DataFrame, budget: int) -> DataFrame:
    by = taken.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.countDistinct("doc_id").alias("documents"), (F.max("copy_no") + 1).cast("long").alias("most_repeats")
    )
    everything = Window.partitionBy(F.lit(1))  # one row per target source
    return goals.join(by, "source", "left").withColumn("_cl_sum", F.sum("tokens").over(everything)).select(
        "source",
        F.round("share", 9).alias("target_share"),
        F.coalesce(F.round(F.col("tokens") / F.col("_cl_sum"), 9), F.lit(0.0)).alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.col("cap").alias("max_repeats"),
    )
