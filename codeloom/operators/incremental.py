"""Processing only new or changed records (problem 3).

Sequence numbers that are already processed are kept as disjoint, closed intervals per group.
A run subtracts them from the ranges of numbers that are available, processes the gaps (which
include numbers below the highest processed one that arrived late), and commits the merged
intervals together with its output.

All interval work goes by blocks of ``BLOCK`` numbers of a group, so that neither a hot group nor
a fragmented one is gathered in a task: intervals are clipped to blocks, merged or swept there,
and only runs that touch the edge of a block (two per block at most) are stitched across blocks.
An interval of n numbers takes n / BLOCK + 2 rows at most.

Defined results: a null sequence number or group is never pending and never committed; empty
inputs give empty outputs; rows of one run that share a number are processed together, and a row
that comes later under a committed number is a redelivery and not processed again (a record needs
a number of its own, such as change_id; ``seq`` of a change feed numbers commits); columns of the
record table are passed through unchanged whatever their names, the operator's own columns start
with ``_cl_``.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import SOURCE_PATH_PATTERN
from codeloom.operators.joins import salted_join
from codeloom.session import cut_lineage

#: Numbers per block.
BLOCK = 1 << 12

INTERVALS = "group_key string, lo long, hi long"


def _clipped(intervals: DataFrame, *keep: str) -> DataFrame:
    """Pieces of the intervals, one per block that they meet, with the block's number."""
    rows = intervals.where("lo IS NOT NULL AND hi IS NOT NULL AND lo <= hi")
    blocks = F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))
    return rows.select("group_key", "lo", "hi", *keep, F.explode(blocks).alias("_cl_block")).select(
        "group_key",
        "_cl_block",
        F.greatest("lo", F.col("_cl_block") * BLOCK).alias("lo"),
        F.least("hi", F.col("_cl_block") * BLOCK + (BLOCK - 1)).alias("hi"),
        *keep,
    )


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Disjoint maximal intervals of the union of closed intervals ``[lo, hi]`` per group.

    Touching intervals (``hi + 1 = lo``) are joined. Runs are merged within blocks first; those
    inside a block are final, those at an edge are stitched across blocks.
    """
    return _stitched(_merge(_clipped(intervals), ("group_key", "_cl_block")))


def _stitched(runs: DataFrame) -> DataFrame:
    """Maximal runs of runs that are maximal within their blocks."""
    edge = (F.col("lo") == F.col("_cl_block") * BLOCK) | (F.col("hi") == F.col("_cl_block") * BLOCK + (BLOCK - 1))
    inner = runs.where(~edge).select("group_key", "lo", "hi")
    return inner.unionByName(_merge(runs.where(edge).drop("_cl_block"), ("group_key",)))


def _merge(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0)
    marked = rows.select(*keys, "lo", "hi", starts.alias("_cl_new"))
    run = F.sum("_cl_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.select(*keys, "lo", "hi", run.alias("_cl_run"))
        .groupBy(*keys, "_cl_run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_cl_run")
    )


def intervals_of(numbers: DataFrame, group: Column, seq: Column, whole: bool = True) -> DataFrame:
    """Disjoint intervals of the sequence numbers that occur; without ``whole`` clipped to blocks, with
    the block's number."""
    points = (
        numbers.select(group.cast("string").alias("group_key"), seq.cast("long").alias("lo"))
        .where("group_key IS NOT NULL AND lo IS NOT NULL")
        .distinct()
        .withColumns({"hi": F.col("lo"), "_cl_block": F.floor(F.col("lo") / BLOCK)})
    )
    runs = _merge(points, ("group_key", "_cl_block"))
    return _stitched(runs) if whole else runs


def subtract_intervals(available: DataFrame, processed: DataFrame, whole: bool = True) -> DataFrame:
    """Gaps: the parts of the available intervals that no processed interval covers, as maximal
    intervals; without ``whole`` clipped to blocks, with the block's number. Processed intervals
    should be clipped to the range of the available numbers.

    Sweep over the interval ends of a block: an elementary range is a gap if an available
    interval and no processed one is open over it. No pairs of intervals are formed.
    """
    pieces = available if "_cl_block" in available.columns else _clipped(available)
    marked = pieces.withColumn("_cl_a", F.lit(1)).unionByName(_clipped(processed.withColumn("_cl_a", F.lit(0)), "_cl_a"))
    keys = ["group_key", "_cl_block"]
    p = 1 - F.col("_cl_a")
    ends = marked.select(*keys, F.inline(F.array(F.struct(F.col("lo").alias("at"), F.col("_cl_a").alias("a"), p.alias("p")), F.struct((F.col("hi") + 1).alias("at"), (-F.col("_cl_a")).alias("a"), (-p).alias("p")))))
    sweep = ends.groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    order = Window.partitionBy(*keys).orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    gaps = sweep.select(
        *keys,
        F.col("at").alias("lo"),
        (F.lead("at").over(order) - 1).alias("hi"),
        F.sum("a").over(running).alias("open_a"),
        F.sum("p").over(running).alias("open_p"),
    ).where("open_a > 0 AND open_p <= 0 AND hi IS NOT NULL")
    runs = _merge(gaps.select(*keys, "lo", "hi"), tuple(keys))
    return _stitched(runs) if whole else runs


def pending(records: DataFrame, processed: DataFrame, group: Column, seq: Column) -> DataFrame:
    """Rows of ``records`` whose sequence number lies in a gap: the processed intervals are
    subtracted from those of the numbers at hand, and the rows of the gaps are taken.

    Gaps are disjoint and clipped to blocks, so a row meets at most one: the join is an equi-join
    on (group, block), not a range join, and a hot group is spread by block.
    """
    gaps = subtract_intervals(intervals_of(records, group, seq, whole=False), processed, whole=False).select(
        F.col("group_key").alias("_cl_group"), F.col("_cl_block").alias("_cl_gblock"), F.col("lo").alias("_cl_lo"), F.col("hi").alias("_cl_hi")
    )
    keyed = records.withColumns({"_cl_rgroup": group.cast("string"), "_cl_rseq": seq.cast("long")}).where("_cl_rgroup IS NOT NULL AND _cl_rseq IS NOT NULL")
    keyed = keyed.withColumn("_cl_rblock", F.floor(F.col("_cl_rseq") / BLOCK))
    on = (
        (F.col("_cl_rgroup") == F.col("_cl_group"))
        & (F.col("_cl_rblock") == F.col("_cl_gblock"))
        & F.col("_cl_rseq").between(F.col("_cl_lo"), F.col("_cl_hi"))
    )
    return keyed.join(gaps, on, "left_semi").drop("_cl_rgroup", "_cl_rseq", "_cl_rblock")


class IncrementalRunner:
    """Runs a transformation over pending records and commits output and intervals together.

    ``root/run=<id>/`` holds a run's output, ``root/state/<n>-<id>`` the merged intervals after it, and
    ``root/HEAD/<n>.json`` names both. Output and state are written first, from one materialised
    reading of the input, so a transformation may drop or add rows and the numbers it was given
    are done all the same. The HEAD file is created last and exclusively (a link in a local file
    system, a rename that never replaces elsewhere), so a run that dies before it leaves no trace
    in what readers see, and a repeated run processes the same gaps again. Two runs that race for
    one commit: the second one fails and nothing of it is visible. A store without such a rename
    needs a lock around ``run``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _heads(self) -> list[int]:
        folder = self._path(f"{self.root}/HEAD")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _head(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/HEAD/{n}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def processed(self) -> DataFrame:
        heads = self._heads()
        if not heads:
            return self.spark.createDataFrame([], INTERVALS)
        return self.spark.read.schema(INTERVALS).parquet(self._head(heads[-1])["state"])

    def committed(self) -> DataFrame | None:
        """All committed output, run by run; null before the first run with rows."""
        runs = [self._head(n)["output"] for n in self._heads()]
        return self.spark.read.parquet(*runs) if runs else None

    def run(self, records: DataFrame, group: Column, seq: Column, transform, fail_before_commit: bool = False) -> int:
        """Processes the gaps once; returns the number of the commit."""
        heads = self._heads()
        n, run_id = (heads[-1] if heads else 0) + 1, uuid.uuid4().hex
        output, state = f"{self.root}/run={run_id}", f"{self.root}/state/{n}-{run_id}"
        todo = cut_lineage(pending(records, self.processed(), group, seq))
        transform(todo).write.mode("overwrite").parquet(output)
        merge_intervals(self.processed().unionByName(intervals_of(todo, group, seq))).write.mode("overwrite").parquet(state)
        if fail_before_commit:
            raise RuntimeError("failed before the commit")
        self._create(f"{self.root}/HEAD/{n}.json", json.dumps({"output": output, "state": state}))
        return n

    def _create(self, name: str, text: str) -> None:
        target, draft = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                hadoop = self.spark._jvm.org.apache.hadoop.fs
                none = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
                none[0] = hadoop.Options.Rename.NONE
                hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, none)
        except Exception as error:
            raise RuntimeError(f"{os.path.basename(name)} was committed by another run") from error
        finally:
            self._fs.delete(draft, False)


# --- the change feed and its checkpoints ---------------------------------------------------

def distinct_changes(changes: DataFrame) -> DataFrame:
    """One row per (repo_id, commit_sha, status, path, old_path): the one with the smallest
    ingested_at (then change_id). Changes without a repository are left out."""
    keys = ["repo_id", "commit_sha", "status", "path", "old_path"]
    first = F.min(F.struct(F.col("ingested_at").isNull(), "ingested_at", "change_id", "seq")).alias("first")
    return (
        changes.where("repo_id IS NOT NULL")
        .groupBy(*keys)
        .agg(first)
        .select(*keys, "first.ingested_at", "first.change_id", "first.seq")
    )


def relevant(changes: DataFrame) -> DataFrame:
    """Changes the indexer acts on: status A, M, D or R, and a source path on either side."""
    source = F.coalesce(F.col("path").rlike(SOURCE_PATH_PATTERN), F.lit(False)) | F.coalesce(
        F.col("old_path").rlike(SOURCE_PATH_PATTERN), F.lit(False)
    )
    return changes.where(F.substring("status", 1, 1).isin("A", "M", "D", "R") & source)


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The row with the latest updated_at per repository; equal times are ordered by content."""
    newest = F.max(F.struct("updated_at", "last_commit", "processed_files")).alias("c")
    return (
        checkpoints.where("repo_id IS NOT NULL AND updated_at IS NOT NULL")
        .groupBy("repo_id")
        .agg(newest)
        .select("repo_id", "c.updated_at", "c.last_commit", "c.processed_files")
    )


def last_sequence(changes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``repo_id, last_seq``: the sequence number of the commit that last_commit names."""
    commits = changes.where("repo_id IS NOT NULL").groupBy("repo_id", "commit_sha").agg(F.max("seq").alias("seq"))
    named = checkpoints.where("last_commit <> ''").select("repo_id", F.lower("last_commit").alias("_cl_sha"))
    return (
        salted_join(commits, named, ["repo_id"], [F.col("commit_sha")])
        .where(F.lower("commit_sha").startswith(F.col("_cl_sha")))
        .groupBy("repo_id")
        .agg(F.max("seq").alias("last_seq"))
    )


def _lane(repo: Column, on_time: Column) -> Column:
    """A repository has two lanes of numbers, rows that had arrived when its checkpoint was written
    and rows that came later."""
    return F.concat(F.when(on_time, F.lit("on time:")).otherwise(F.lit("late:")), repo)


def checkpoint_intervals(state: DataFrame, feed: DataFrame) -> DataFrame:
    """Processed numbers of the checkpoints: from the first number of the feed to that of
    last_commit, in the on-time lane of the repository. In its late lane nothing is processed, so
    the number of a late row is a gap although a higher one is done. A checkpoint whose
    last_commit names nothing has no interval."""
    first = feed.groupBy("repo_id").agg(F.min("seq").cast("long").alias("lo"))
    return state.where("last_seq IS NOT NULL").join(first, "repo_id").select(
        _lane(F.col("repo_id"), F.lit(True)).alias("group_key"), "lo", F.col("last_seq").cast("long").alias("hi")
    )


def pending_changes(changes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Exactly the changes that the next run has to process (TESTDATA.md, p3_found).

    The processed interval of a checkpoint is subtracted from the numbers that are available in
    the lanes of its repository; the changes of the gaps are left. Of them, on-time changes whose
    path is among processed_files are done too; a change without a number lies in no interval and
    is pending unless its path is listed.
    """
    latest = latest_checkpoints(checkpoints)
    state = latest.join(last_sequence(changes, latest), "repo_id", "left")
    files = latest.select("repo_id", F.explode("processed_files").alias("path")).where("path IS NOT NULL").distinct()
    feed = salted_join(relevant(distinct_changes(changes)), state.select("repo_id", "updated_at"), ["repo_id"], [F.col("commit_sha"), F.col("path")], "left")
    feed = feed.withColumn("_cl_on_time", F.coalesce(F.col("ingested_at") <= F.col("updated_at"), F.lit(False)))
    feed = cut_lineage(feed.withColumn("_cl_lane", _lane(F.col("repo_id"), F.col("_cl_on_time"))))  # read four times
    gaps = pending(feed, checkpoint_intervals(state, feed), F.col("_cl_lane"), F.col("seq")).unionByName(feed.where("seq IS NULL"))
    listed = files.withColumn("_cl_on_time", F.lit(True))
    return gaps.join(listed, ["repo_id", "path", "_cl_on_time"], "left_anti").drop("_cl_on_time", "_cl_lane")
