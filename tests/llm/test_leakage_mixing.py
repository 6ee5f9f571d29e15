import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.llm import leakage as L
from codeloom.llm import mixing as M

ITEMS = "item_id long, suite string, prompt string, solution string"


def _words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _brute(docs, items, n=12):
    out = set()
    for d, text in docs:
        words = _words(text)
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        for item, prompt, solution in items:
            for passage in (prompt, solution):
                p = _words(passage)
                if any(tuple(p[i : i + n]) in grams for i in range(len(p) - n + 1)):
                    out.add((d, item))
    return out


def test_hits_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))), None if i % 3 else " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(12)]
    docs = []
    for d in range(80):
        words = [rng.choice([*vocabulary, "x", "y"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            source = _words(rng.choice(items)[1])
            k = rng.choice([11, 12, 13, 30])
            at = rng.randint(0, max(0, len(source) - k))
            words[len(words) // 2 : len(words) // 2] = source[at : at + k]
        docs.append((d, rng.choice([" ", "_", ", ", "\n", "--"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (3, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    table = spark.createDataFrame([(i, None, p, s) for i, p, s in items] + [(None, None, "a", None), (99, None, None, None)], ITEMS)
    want = _brute([d for d in docs if d[0] is not None], items)
    got = {(r["doc_id"], r["item_id"]) for r in L.scan(frame, table).collect()}
    assert got == want and want
    assert {(r["doc_id"], r["item_id"]) for r in L.scan(frame, table, budget=100).collect()} == want  # in slices
    assert L.scan(frame.limit(0), table).count() == 0 and L.scan(frame, table.limit(0)).count() == 0


def test_shared_passages_name_all_items_and_spans_are_removed(spark):
    shared = " ".join(f"p{i}" for i in range(15))
    items = spark.createDataFrame([(1, None, shared, None), (2, None, "x " + shared, None), (3, None, " ".join(f"p{i}" for i in range(11)), None)], ITEMS)
    tail = " ".join(f"own{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"Start. {shared}! {tail}"), (2, shared), (3, tail), (4, None)], "doc_id long, text string")
    spans = L.scan(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in spans.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert {r["item_id"]: (r["documents"], r["longest_passage"]) for r in L.report(spans).collect()} == {1: (2, 15), 2: (2, 15)}
    out = {r["doc_id"]: r for r in L.decontaminate(docs, spans).collect()}
    assert out[1]["text"] == f"Start. ! {tail}" and out[1]["removed_words"] == 15
    assert out[2]["dropped"] and out[2]["text"] is None and out[3]["text"] == tail and out[4]["text"] is None


def test_spans_are_cut_where_lower_case_is_longer(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, None, passage, None)], ITEMS)
    rows = [(1, f"İİİİ keep {passage} tail stays here and more words follow it now"), (1, "another text of the id"), (2, "İ " + passage.upper() + " a b c d e f g h i j k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"], r["text"], r["removed_words"]) for r in L.decontaminate(docs, L.scan(docs, items), 0.9).collect())
    assert out == [(1, "another text of the id", 0), (1, "İİİİ keep  tail stays here and more words follow it now", 12), (2, "İ  a b c d e f g h i j k l m n o", 12)]


def test_runs_that_repeat_in_items_name_them_all():
    words = " ".join(f"w{i}" for i in range(13))
    passages = L.Passages([(7, words, None), (9, None, "x " + words), (11, "w1 w2", words[:-4])], 12)
    assert passages.hits([words, None, "", words[:-4] + " q"]) == [[(0, (7, 9, 11)), (1, (7, 9))], [], [], [(0, (7, 9, 11))]]


WEIGHTS = "source string, target_share double, max_repeats int"


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))


def test_shares_are_reached_within_the_caps(spark):
    rng = random.Random(6)
    rows = [(i, "Big", "alpha beta gamma " * rng.randint(1, 20)) for i in range(300)]
    rows += [(1000 + i, rng.choice(["small-one", " SMALL ONE "]), "delta " * rng.randint(5, 30)) for i in range(25)]
    rows += [(2000, "other", "x"), (None, "big", "x"), (2001, None, "x"), (2002, "big", None), (2003, "big", ""), rows[0]]
    weights = spark.createDataFrame([("big", 0.6, 1), ("small_one", 0.4, 4), ("small_one", 0.4, 4), (None, 0.5, 1), ("void", 0.0, 3), ("bad", None, 3)], WEIGHTS)
    out = M.mix(_documents(spark, rows), weights)
    copies = out.copies.collect()
    shares = {r["source"]: r for r in out.shares.collect()}
    assert set(shares) == {"big", "small_one"}
    assert abs(shares["big"]["reached_share"] - 0.6) < 0.02 and abs(shares["small_one"]["reached_share"] - 0.4) < 0.02
    assert shares["big"]["most_repeats"] == 1 and shares["small_one"]["most_repeats"] <= 4
    assert len({(r["doc_id"], r["copy_no"]) for r in copies}) == len(copies)
    # Brute force: the queue in full, in order, cut at the budget.
    sizes = {}
    for r in copies:
        sizes[r["doc_id"], r["source"]] = r["tokens"]
    total = sum(r["tokens"] for r in copies)
    small = sum({d: s for (d, source), s in sizes.items() if source == "small_one"}.values())
    assert total <= small * 4 / 0.4 and total > 0.9 * min(small * 4 / 0.4, 1e9) or shares["big"]["documents"] >= 299


def test_the_queue_is_cut_at_a_given_budget(spark):
    rows = [(i, "a" if i % 2 else "b", "one two three four") for i in range(200)]
    weights = spark.createDataFrame([("a", 3.0, 2), ("b", 1.0, 2)], WEIGHTS)
    out = M.mix(_documents(spark, rows), weights, budget=200)
    got = out.copies.collect()
    assert sum(r["tokens"] for r in got) <= 200 and sum(r["tokens"] for r in got) > 190
    shares = {r["source"]: r["reached_share"] for r in out.shares.collect()}
    assert abs(shares["a"] - 0.75) < 0.03
    again = M.mix(_documents(spark, rows), weights, budget=200).copies.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_a_dry_source_leaves_its_share_to_the_others(spark):
    rows = [(i, "a", "one two three four") for i in range(10)] + [(100 + i, "b", "one two three four") for i in range(30)]
    weights = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 100)], WEIGHTS)
    out = M.mix(_documents(spark, rows), weights, budget=2000)
    shares = {r["source"]: r for r in out.shares.collect()}
    assert shares["a"]["tokens"] == 80 and shares["a"]["most_repeats"] == 2
    assert shares["a"]["tokens"] + shares["b"]["tokens"] == 2000 and shares["b"]["most_repeats"] == 16
    everything = M.mix(_documents(spark, rows), weights, budget=10**9)
    assert {r["source"]: r["copies"] for r in everything.shares.collect()} == {"a": 20, "b": 3000}


def test_a_source_without_documents_does_not_empty_the_mix(spark):
    rows = [(i, "a" if i % 2 else "b", "one two three four") for i in range(40)]
    weights = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 1), ("missing", 0.2, 5)], WEIGHTS)
    shares = {r["source"]: r for r in M.mix(_documents(spark, rows), weights).shares.collect()}
    assert shares["missing"]["tokens"] == 0 and shares["missing"]["target_share"] == 0.2
    assert shares["a"]["reached_share"] == 0.5 and shares["a"]["documents"] == 20


def test_last_time_is_where_the_sources_give_the_tokens():
    sources = [(0.5, 10.0), (0.3, 100.0), (0.2, 4.0)]
    for tokens in (1.0, 12.0, 30.0, 100.0):
        time = M.last_time(sources, tokens)
        assert abs(sum(min(capacity, share * time) for share, capacity in sources) - tokens) < 1e-9
    assert M.last_time(sources, 1000.0) == 100.0 / 0.3 and M.last_time([], 1.0) == 0.0


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, "a" if i % 3 else "b", "one two " * (1 + i % 5)) for i in range(150)]
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], WEIGHTS)
    one = sorted(map(tuple, M.mix(_documents(spark, rows), weights).copies.collect()))
    monkeypatch.setattr(M, "BLOCK_ROWS", 7)
    many = sorted(map(tuple, M.mix(_documents(spark, rows), weights).copies.collect()))
    assert one == many and one


@pytest.mark.parametrize("rows,weights", [([], [("a", 0.5, 1)]), ([(1, "a", "x")], []), ([(1, "q", "x")], [("a", 0.5, 1)])])
def test_empty_mixes(spark, rows, weights):
    out = M.mix(_documents(spark, rows), spark.createDataFrame(weights, WEIGHTS))
    assert out.copies.count() == 0 and out.shares.where("tokens > 0").count() == 0


def test_token_counts(spark):
    frame = spark.createDataFrame([("hello world",), ("",), (None,), ("a" * 5000,), ("<|endoftext|>",)], "t string")
    counts = [r[0] for r in frame.select(M.token_count(F.col("t"))).collect()]
    assert counts[0] == 2 and counts[1:3] == [0, 0] and counts[3] > 10 and counts[4] > 1
