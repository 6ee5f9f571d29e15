import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.operators import incremental as inc

GAPS = st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 30), st.integers(0, 6)), max_size=12)
QUIET = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, rows):
    return spark.createDataFrame([(g, lo, lo + n) for g, lo, n in rows], inc.INTERVALS)


def _points(rows):
    return {(r["group_key"], k) for r in rows for k in range(r["lo"], r["hi"] + 1)}


def _raw(rows):
    return {(g, k) for g, lo, n in rows for k in range(lo, lo + n + 1)}


@QUIET
@given(GAPS)
def test_merged_intervals_are_disjoint_and_maximal(spark, rows):
    out = inc.merge_intervals(_frame(spark, rows)).collect()
    assert _points(out) == _raw(rows)
    by = {}
    for r in out:
        by.setdefault(r["group_key"], []).append((r["lo"], r["hi"]))
    for spans in by.values():
        spans.sort()
        assert all(b[0] > a[1] + 1 for a, b in zip(spans, spans[1:], strict=False))


@QUIET
@given(GAPS, GAPS)
def test_subtraction_leaves_exactly_the_gaps(spark, available, processed):
    out = inc.subtract_intervals(_frame(spark, available), _frame(spark, processed)).collect()
    assert _points(out) == _raw(available) - _raw(processed)


def test_merging_across_blocks(spark):
    edge = inc.BLOCK
    rows = spark.createDataFrame([("a", edge - 2, edge - 1), ("a", edge, edge + 1), ("a", edge + 3, 3 * edge)], inc.INTERVALS)
    assert sorted(tuple(r) for r in inc.merge_intervals(rows).collect()) == [("a", edge - 2, edge + 1), ("a", edge + 3, 3 * edge)]
    records = spark.createDataFrame([("a", edge + 2), ("a", 2 * edge), ("a", None), (None, 1), ("b", 5)], "g string, s long")
    left = inc.pending(records, inc.merge_intervals(rows), F.col("g"), F.col("s"))
    assert sorted(tuple(r) for r in left.collect()) == [("a", edge + 2), ("b", 5)]


def test_runs_are_exactly_once_across_failures_and_late_commits(spark, tmp_path):
    runner = inc.IncrementalRunner(spark, str(tmp_path / "out"))
    group, seq = F.col("repo"), F.col("seq")
    kind = "repo string, seq long, body string, _note string"

    def feed(*rows):
        return spark.createDataFrame([(r, s, f"{r}{s}", None) for r, s in rows], kind)

    first = feed(("a", 1), ("a", 2), ("a", 5), ("b", 1))
    assert runner.committed() is None
    with pytest.raises(RuntimeError):
        runner.run(first, group, seq, lambda d: d, fail_before_commit=True)
    assert runner.committed() is None and runner.processed().count() == 0
    assert runner.run(first, group, seq, lambda d: d) == 1
    second = feed(("a", 1), ("a", 2), ("a", 3), ("a", 5), ("a", 6), ("b", 1), ("b", 1))
    assert runner.run(second, group, seq, lambda d: d) == 2
    assert runner.run(second, group, seq, lambda d: d) == 3  # nothing left
    done = sorted(r["body"] for r in runner.committed().collect())
    assert done == ["a1", "a2", "a3", "a5", "a6", "b1"]
    assert sorted(tuple(r) for r in runner.processed().collect()) == [("a", 1, 3), ("a", 5, 6), ("b", 1, 1)]


def test_a_transformation_that_filters_does_not_leave_numbers_pending(spark, tmp_path):
    runner = inc.IncrementalRunner(spark, str(tmp_path / "filtered"))
    feed = spark.createDataFrame([("a", n, n % 2) for n in range(10)], "repo string, change_id long, odd int")
    seen = []

    def odd_only(todo):
        seen.append(todo.count())
        return todo.where("odd = 1")

    for _ in range(2):
        runner.run(feed, F.col("repo"), F.col("change_id"), odd_only)
    assert seen == [10, 0]
    assert runner.committed().count() == 5
    assert [tuple(r) for r in runner.processed().collect()] == [("a", 0, 9)]


def test_records_that_share_a_commit_number_are_told_apart_by_their_own(spark, tmp_path):
    runner = inc.IncrementalRunner(spark, str(tmp_path / "own"))
    kind = "repo string, seq int, change_id long"
    runner.run(spark.createDataFrame([("a", 1, 10), ("a", 1, 11)], kind), F.col("repo"), F.col("change_id"), lambda d: d)
    runner.run(spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 1, 12)], kind), F.col("repo"), F.col("change_id"), lambda d: d)
    assert sorted(r["change_id"] for r in runner.committed().collect()) == [10, 11, 12]


@pytest.mark.parametrize("name", ["intervals_of", "subtract_intervals", "pending"])
def test_pending_changes_come_from_the_intervals(spark, monkeypatch, name):
    monkeypatch.setattr(inc, name, lambda *a, **k: (_ for _ in ()).throw(AssertionError(name)))
    with pytest.raises(AssertionError, match=name):
        _case(spark, [(1, "r", 1, "a" * 40, "A", "x.py", None, None, 0)], [])


def test_a_fragmented_group_is_swept_by_blocks(spark):
    step = spark.range(0, 6 * inc.BLOCK, 2).select(F.lit("a").alias("g"), F.col("id").alias("s"))
    done = spark.createDataFrame([("a", inc.BLOCK - 3, 2 * inc.BLOCK + 3)], inc.INTERVALS)
    left = inc.pending(step, done, F.col("g"), F.col("s"))
    want = {k for k in range(0, 6 * inc.BLOCK, 2) if not inc.BLOCK - 3 <= k <= 2 * inc.BLOCK + 3}
    assert {r["s"] for r in left.collect()} == want
    assert inc.intervals_of(step, F.col("g"), F.col("s")).count() == 3 * inc.BLOCK


def test_a_number_is_committed_by_one_run_only(spark, tmp_path):
    runner = inc.IncrementalRunner(spark, str(tmp_path / "race"))
    runner._create(f"{runner.root}/HEAD/1.json", "{}")
    with pytest.raises(RuntimeError):
        runner._create(f"{runner.root}/HEAD/1.json", "{}")


T = datetime.datetime(2018, 1, 1)


def _hours(n):
    return T + datetime.timedelta(hours=n)


def _case(spark, rows, states):
    changes = spark.createDataFrame(rows, "change_id long, repo_id string, seq int, commit_sha string, status string, path string, old_path string, ingested_at timestamp, lo long")
    checkpoints = spark.createDataFrame(states, "repo_id string, processed_files array<string>, last_commit string, updated_at timestamp")
    return sorted(r[0] for r in inc.pending_changes(changes, checkpoints).select("change_id").collect())


def test_pending_changes(spark):
    sha = "ab" * 20
    other = "cd" * 20
    rows = [
        (1, "r", 1, sha, "M", "a.py", None, _hours(1), 0),  # processed
        (2, "r", 2, other, "M", "a.py", None, _hours(2), 0),  # behind last_commit
        (3, "r", 1, sha, "M", "late.PY", None, _hours(9), 0),  # late commit
        (4, "r", 2, other, "A", "done.py", None, _hours(2), 0),  # in processed_files
        (5, "r", 2, other, "A", "done.py", None, _hours(1), 0),  # delivered again, earlier
        (6, None, 2, other, "A", "x.py", None, _hours(2), 0),
        (7, "r", 2, other, "T", "x.py", None, _hours(2), 0),
        (8, "r", 2, other, None, "x.py", None, _hours(2), 0),
        (9, "r", 2, other, "R090", "x.md", "x.go", _hours(2), 0),
        (10, "new", 1, other, "A", "x.rs", None, _hours(2), 0),  # no checkpoint
        (11, "r", 2, other, "A", "Makefile", None, _hours(2), 0),
        (12, "r", 3, other, "A", "done.py", None, _hours(8), 0),  # late in spite of processed_files: same key as 4
        (13, "null", 1, sha, "A", "n.py", None, _hours(1), 0),
    ]
    states = [
        ("r", ["done.py", "done.py", None], sha[:13].upper(), _hours(5)),
        ("r", ["done.py", "done.py", None], sha[:13].upper(), _hours(5)),
        ("r", None, other, _hours(4)),
        ("null", None, None, _hours(5)),
        (None, None, None, None),
    ]
    assert _case(spark, rows, states) == [2, 3, 9, 10, 13]


def test_pending_changes_of_empty_tables(spark):
    assert _case(spark, [], []) == []
    assert _case(spark, [(1, "r", 1, "a" * 40, "A", "x.py", None, None, 0)], []) == [1]
    assert _case(spark, [], [("r", None, None, _hours(1))]) == []


def test_a_change_without_a_number_is_pending_unless_its_path_is_listed(spark):
    rows = [(1, "r", None, "a" * 40, "A", "x.py", None, _hours(1), 0), (2, "r", None, "a" * 40, "A", "y.py", None, _hours(1), 0)]
    assert _case(spark, rows, [("r", ["y.py"], None, _hours(5))]) == [1]
