import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.llm import nearcopies as N


def _runs(text):
    words = [w.lower() for w in re.findall(r"[A-Za-z0-9_]+", text)]
    return set(zip(words, words[1:], words[2:], strict=False))


def _brute(rows, threshold=0.6):
    texts = {}
    for key, text in rows:
        if key is not None and text is not None:
            texts[key] = text
    out, keys = set(), sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = _runs(texts[a]), _runs(texts[b])
            if texts[a] == texts[b] or (x | y and 10_000 * len(x & y) >= round(threshold * 10_000) * len(x | y)):
                out.add((a, b))
    return out


def _corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randint(0, 2)] = [rng.choice(words)] * rng.randint(0, 2)
            rows.append((i, " ".join(text) or "w0"))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 12, 25, 80])))))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").withColumn("runs", F.lit("x"))


def _pairs(spark, rows, threshold=0.6):
    return {tuple(r) for r in N.near_pairs(_frame(spark, rows), "id", "text", threshold).collect()}


@pytest.mark.parametrize("seed,threshold", [(1, 0.6), (2, 0.8)])
def test_pairs_equal_brute_force(spark, seed, threshold):
    rows = _corpus(seed)
    assert _pairs(spark, rows, threshold) == _brute(rows, threshold)


@pytest.mark.parametrize("boundary", [0, 12])
def test_long_lists_are_paired_by_blocks(spark, monkeypatch, boundary):
    monkeypatch.setattr(N, "LIST_BLOCK", 7)
    monkeypatch.setattr(N, "choose_boundary", lambda sizes, threshold: N.Plan(boundary, 1000))
    rng = random.Random(9)
    rows = _corpus(5, 60) + [(1000 + i, "one hot run here " + " ".join(rng.choice("pqrs") for _ in range(rng.randint(1, 4)))) for i in range(80)]
    assert _pairs(spark, rows) == _brute(rows)


def test_pairs_of_blocks_are_those_of_the_list():
    rng = np.random.default_rng(4)
    size = np.sort(rng.integers(5, 30, 50))
    cls, fallen = rng.permutation(50).astype(np.int64), (rng.random(50) < 0.1).astype(np.int64)
    whole = pd.concat(N._pairs_of(np.zeros(50, np.int64), cls, size, fallen, 0.6))
    old, N.LIST_BLOCK = N.LIST_BLOCK, 8
    try:
        parts = pd.concat(N._pair_blocks(N._block_pairs(cls, size, fallen, True, 0.6), 0.6))
    finally:
        N.LIST_BLOCK = old
    assert sorted(map(tuple, whole[["a", "b", "need", "hits"]].to_numpy())) == sorted(map(tuple, parts[["a", "b", "need", "hits"]].to_numpy()))


@pytest.mark.parametrize("boundary", [0, 8, 32])
def test_any_boundary_gives_the_same_pairs(spark, monkeypatch, boundary):
    monkeypatch.setattr(N, "choose_boundary", lambda sizes, threshold: N.Plan(boundary, 1000))
    rows = _corpus(3, 90)
    assert _pairs(spark, rows) == _brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (None, "a b c d"), (2, ""), (3, ""), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "a-b.C"), (8, "ünïcödé a b c"), (6, "a b c")]
    assert _pairs(spark, rows) == {(2, 3), (6, 7)}
    assert _pairs(spark, []) == set()


def test_many_copies_of_one_text(spark):
    rows = [(i, "one two three four five six") for i in range(60)] + [(100, "one two three four five six seven")]
    got = _pairs(spark, rows)
    assert len(got) == 61 * 60 // 2


def test_groups_follow_links(spark):
    base = " ".join(f"t{i}" for i in range(40))
    chain = [base]
    for k in range(4):
        words = chain[-1].split()
        words[k * 8 : k * 8 + 3] = [f"n{k}a", f"n{k}b", f"n{k}c"]
        chain.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(chain)] + [(10, base), (20, "other words that match nothing here")]
    out = {r["id"]: r for r in N.groups(_frame(spark, rows), "id", "text").collect()}
    assert len(out) == 7 and len({out[i]["group_id"] for i in (0, 1, 2, 3, 4, 10)}) == 1
    assert out[20]["group_id"] != out[0]["group_id"] and out[20]["links"] == 0 and out[0]["class_id"] == out[10]["class_id"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    out = {r["node"]: r["component"] for r in N.components(edges).collect()}
    assert {out[i] for i in range(41)} == {0} and out[101] == out[100] == 100


def test_the_boundary_has_the_least_cost():
    few = {6: (10, 0.0, 0.0), 200: (10, 0.0, 0.0)}
    assert N.choose_boundary(few, 0.6).boundary == 0
    hot = {6: (1000, 1e6, 0.0)}
    assert N.choose_boundary(hot, 0.6).boundary >= 6
    assert N.choose_boundary({}, 0.6) == N.Plan(0, 0)
