import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as text_functions
from codeloom.functions.embed import HashingEmbedder, embed_rows
from codeloom.operators import bundle, changes, chunking, graph, lookup, search
from codeloom.streaming import triggers


def _loop(n, size=150, overlap=20):
    """Parts of n lines by the stated rule, step by step."""
    if n <= size:
        return [(0, n)]
    out, at = [], 0
    while at < n:
        end = min(at + size, n)
        out.append((at, end))
        step = end - overlap
        if step <= at or step >= n:
            break
        at = step
    return out


def test_part_ranges_equal_the_loop(spark):
    rows = spark.range(1, 1200).select(F.col("id").cast("int").alias("n"))
    for n, parts in rows.select("n", chunking.part_ranges(F.col("n"))).collect():
        assert [(p["start"], p["end"]) for p in parts] == _loop(n)
        assert [p["part"] for p in parts] == ([0] if n <= 150 else list(range(1, len(parts) + 1)))


def _comment_start(lines, index):
    result, blanks = index, 0
    for i in range(index - 1, -1, -1):
        t = lines[i].strip()
        if not t:
            blanks += 1
            if blanks >= 2:
                break
            continue
        blanks = 0
        if t.startswith(("//", "#", "*", '"""', "'''", "/*")):
            result = i
        else:
            break
    return max(result, 0)


def test_leading_comments_equal_the_loop(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(300):
        lines = [rng.choice(["// a", "", "  ", "x = 1", "\t* b", '"""doc', "# c", "\t"]) for _ in range(rng.randint(1, 9))]
        cases.append((lines, rng.randint(0, len(lines) - 1)))
    frame = spark.createDataFrame(cases, "lines array<string>, i int")
    for lines, i, got in frame.select("lines", "i", chunking.leading_comment_start(F.col("lines"), F.col("i"))).collect():
        assert got == _comment_start(lines, i), (lines, i)


def test_split_symbols_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "f", None), (2, "f", ""), (3, None, "a\nb"), (4, "g", "\n".join(map(str, range(160))))], "id int, symbol_name string, source_text string")
    out = chunking.split_symbols(rows, ["id"]).collect()
    assert [(r["id"], r["part_name"]) for r in out] == [(3, None), (4, "g [part 1]"), (4, "g [part 2]"), (4, "g [part 3]")]


def test_extract_chunks_names_methods_and_takes_comments(spark):
    files = spark.createDataFrame([("r", "a.py", "# top\ndef f():\n    pass\n\nclass C:\n    # m\n    def g(self):\n        pass")], "repo_id string, file_path string, content string")
    kind = "repo_id string, file_path string, kind string, name string, class_name string, start_line int, end_line int, language string"
    symbols = spark.createDataFrame(
        [("r", "a.py", "function", "f", "", 2, 3, "python"), ("r", "a.py", "class", "C", "", 5, 8, "python"), ("r", "a.py", "function", "g", "C", 7, 8, "python"), ("r", "a.py", "import", "x", "", 1, 1, "python")], kind
    )
    got = {r["symbol_name"]: (r["start_line"], r["end_line"], r["base_name"]) for r in chunking.extract_chunks(files, symbols).collect()}
    assert got == {"f": (1, 3, "f"), "C": (5, 8, "C"), "C.g": (6, 8, "g")}


def test_search_filters_before_and_thresholds_after_the_limit(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0], "python"), (2, [0.9, 0.1], "go"), (3, [0.0, 1.0], "python"), (4, None, "python"), (5, [0.0, 0.0], "python"), (6, [1.0, 0.0], "python")],
        "id int, v array<float>, language string",
    )
    hits = search.vector_search(rows, [1.0, 0.0], "v", "id", search.metadata_filter(language="python"), k=2)
    assert [r["id"] for r in hits.collect()] == [1, 6]
    hits = search.vector_search(rows, [1.0, 0.0], "v", "id", search.metadata_filter(language="python"), k=3)
    assert [r["id"] for r in hits.collect()] == [1, 6]  # the third is below the threshold
    assert search.vector_search(rows.limit(0), [1.0, 0.0], "v", "id").count() == 0
    assert search.vector_search(rows, [1.0, 0.0], "v", "id", search.metadata_filter(language="' OR 1=1 --")).count() == 0
    assert rows.select(search.cosine(F.col("v"), F.col("v"))).where("id = 1").first()[0] == pytest.approx(1.0)


def test_batch_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(90, None), (91, [0.0] * 6)]
    rows = spark.createDataFrame(data, "id long, v array<double>")
    got = search.batch_top_k(rows, rows.where("id % 20 = 0"), "v", "id", 4, block=16).collect()
    vectors = {i: v for i, v in data if v and any(v)}

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    for q in (0, 20, 40, 60, 80):
        best = sorted(((-round(score(vectors[q], v), 12), i) for i, v in vectors.items() if i != q))[:4]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in best]


def test_lookup_falls_back_only_without_exact_hits(spark):
    one = spark.createDataFrame([("r1", "load", 1), ("r1", "loader", 2), ("r2", "Load", 3), ("r2", None, 4)], "repo_id string, name string, id int")
    symbols = lookup.tagged([("function", one), ("class", one.limit(0))])
    assert sorted(r["id"] for r in lookup.exact_else_prefix(symbols, "load").collect()) == [1]
    assert sorted(r["id"] for r in lookup.exact_else_prefix(symbols, "lo").collect()) == [1, 2]
    assert lookup.exact_else_prefix(symbols, "zzz").count() == 0
    assert lookup.exact_else_prefix(symbols, "").count() == 3
    repos = spark.createDataFrame([("r1",), (None,)], "id string")
    assert lookup.in_repositories(symbols, repos).count() == 2
    assert lookup.in_repositories(symbols, repos, "r2").count() == 0


def test_call_resolution_prefers_the_same_file(spark):
    functions = spark.createDataFrame(
        [("r", "a.ts", "f", "", 0), ("r", "a.ts", "g", "", 1), ("r", "b.ts", "g", "", 0), ("r", "b.ts", "h", "", 1), ("s", "a.ts", "h", "", 0)],
        "repo_id string, file_path string, name string, class_name string, ordinal int",
    )
    sites = spark.createDataFrame([("r", "a.ts", "g"), ("r", "a.ts", "g"), ("r", "a.ts", "h"), ("r", "c.ts", "g"), ("r", "a.ts", "nothing"), ("r", "a.ts", None)], "repo_id string, file_path string, callee_name string")
    resolved = graph.resolve_calls(sites, functions).collect()
    assert sorted((r["file_path"], r["callee_name"], r["callee_file"] or "") for r in resolved) == [
        ("a.ts", "g", "a.ts"), ("a.ts", "g", "a.ts"), ("a.ts", "h", "b.ts"), ("a.ts", "nothing", ""), ("c.ts", "g", "a.ts"), ("c.ts", "g", "b.ts"),
    ]
    edges = sorted(tuple(r)[1:] for r in graph.call_edges(sites, functions).collect())
    assert edges == [("f", "a.ts", "g", "a.ts", False), ("f", "a.ts", "h", "b.ts", True)]  # c.ts has no function


def test_upserts_and_detached_deletes(spark):
    kind = "repo_id string, name string, file_path string, class_name string, language string, start_line int, ordinal int"
    old = spark.createDataFrame([("r", "f", "a", "", "go", 1, 0), ("r", "g", "a", "", "go", 5, 1)], kind)
    new = spark.createDataFrame([("r", "f", "a", "", "rust", 9, 0), ("r", "f", "a", "", "rust", 11, 1), ("r", "f", "a", "C", "rust", 7, 2)], kind)
    out = graph.upsert(old, new, graph.NODE_KEYS["function"], [F.col("ordinal")], ("language",))
    assert sorted((r["name"], r["class_name"], r["language"], r["start_line"]) for r in out.collect()) == [("f", "", "go", 11), ("f", "C", "rust", 7), ("g", "", "go", 5)]
    nodes = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_id string, file_path string")
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "b"), ("r", "b", "a")], "repo_id string, caller_file string, callee_file string")
    left, kept = graph.detach_delete(nodes, edges, nodes.where("file_path = 'a'"))
    assert [r["file_path"] for r in left.collect()] == ["b"]
    assert [(r["caller_file"], r["callee_file"]) for r in kept.collect()] == [("b", "b")]


def test_methods_need_their_class_in_the_file(spark):
    functions = spark.createDataFrame([("r", "a", "m", "C"), ("r", "b", "m", "C"), ("r", "a", "f", "")], "repo_id string, file_path string, name string, class_name string")
    classes = spark.createDataFrame([("r", "a", "C")], "repo_id string, file_path string, name string")
    assert [tuple(r) for r in graph.has_method(classes, functions).collect()] == [("r", "a", "C", "m")]


def _fold(items, used, budget):
    kept, hit = [], False
    for key, size in items:
        if used >= budget:
            hit = True
        elif size == 0:
            continue
        elif used + size > budget:
            hit = True
        else:
            kept.append(key)
            used += size
    return used, kept, hit


def test_bundle_fills(spark):
    rng = random.Random(9)
    rows, seeds, want = [], [], {}
    for g in range(60):
        used = rng.randint(0, 40)
        items = [(k, rng.choice([0, 3, 8, 20, 40])) for k in range(rng.randint(0, 9))]
        seeds.append((g, used))
        rows += [(g, k, size) for k, size in items]
        want[g] = _fold(items, used, 50)
    candidates = spark.createDataFrame(rows, "g int, item long, size int")
    totals = spark.createDataFrame(seeds, "g int, used long")
    got = bundle.fill_related(candidates, totals, ["g"], F.col("item").cast("int"), "item", F.col("size"), 50)
    assert {r["g"]: (r["total_chars"], r["related"], r["budget_reached"]) for r in got.collect()} == want
    hits = spark.createDataFrame([(1, k, n) for k, n in enumerate([10, 10, 35, 1])], "g int, rank int, n int")
    assert [r["rank"] for r in bundle.fill_seeds(hits, ["g"], [F.col("rank")], F.col("n"), 50).orderBy("rank").collect()] == [0, 1]


def test_format_bundle(spark):
    none = spark.createDataFrame([], "section string, rank int, markdown string")
    assert bundle.format_bundle(none).first()[0] == bundle.EMPTY_BUNDLE
    row = spark.range(1).select(
        F.lit("seed").alias("section"), F.lit(1).alias("rank"),
        bundle.format_chunk(F.lit("f"), F.lit("a.py"), F.lit(0), F.lit(0), F.lit("python"), F.lit("x"), F.lit("caller of g")).alias("markdown"),
    )
    text = bundle.format_bundle(row).first()[0]
    assert "lines unknown" in text and "caller of g" in text and text.rstrip().endswith("## Related Code")


LINES = ["A\tsrc/new.ts", "M\tsrc/existing.ts", "D\tsrc/removed.ts", "R100\tsrc/old.ts\tsrc/new.ts", "", "C100\ta\tb", "T\tx"]


def test_status_lines(spark):
    frame = spark.createDataFrame([(x,) for x in LINES], "line string")
    got = [tuple(r)[1:] for r in changes.parse_status_lines(frame).collect()]
    assert got == [("A", "src/new.ts", None), ("M", "src/existing.ts", None), ("D", "src/removed.ts", None), ("R", "src/new.ts", "src/old.ts")]


def test_incremental_apply_is_idempotent_and_equals_a_rebuild(spark):
    kind = "repo_id string, file_path string, v int"
    before = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("r", "c", 1), ("s", "a", 1)], kind)
    after = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "d", 2), ("s", "a", 1)], kind)
    delta = spark.createDataFrame([("r", "M", "b", None), ("r", "R", "d", "c")], "repo_id string, status string, path string, old_path string")
    once = changes.apply(before, delta, after)
    twice = changes.apply(once, delta, after)
    want = sorted(map(tuple, after.collect()))
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


@pytest.mark.parametrize(
    "args,mode",
    [(("full", "a", "b", True), "full"), (("resume", None, None, True), "resume"), (("incremental", None, "b", True), "full"), (("incremental", "a", "b", False), "full"), (("incremental", "a", "a", True), "none"), (("incremental", "a", "b", True), "incremental")],
)
def test_run_mode(args, mode):
    assert changes.run_mode(*args) == mode


def _at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_debounce_and_lock(spark):
    rows = [("a", _at(0)), ("a", _at(2)), ("a", _at(6)), ("a", _at(11)), ("b", _at(1)), (None, _at(1)), ("a", None)]
    frame = spark.createDataFrame(rows, "repo_id string, ts timestamp")
    fires = triggers.debounce(frame, "repo_id", "ts")
    got = sorted((r["repo_id"], r["fires_at"], r["triggers"]) for r in fires.collect())
    assert got == [("a", _at(11), 3), ("a", _at(16), 1), ("b", _at(6), 1)]  # exactly one gap later starts anew
    locked = triggers.drop_while_running(fires.select("repo_id", "fires_at"), "repo_id", "fires_at", 5_000_001)
    assert sorted((r["repo_id"], r["runs"]) for r in locked.collect()) == [("a", False), ("a", True), ("b", True)]
    array = spark.createDataFrame([([0, 3, 5, 9],)], "t array<bigint>").select(triggers.fold_locked(F.col("t"), 5)).first()[0]
    assert array == [0, 5]


def test_debounce_of_a_stream_equals_the_batch(spark, tmp_path):
    rows = [("a", _at(0)), ("a", _at(2)), ("a", _at(30)), ("b", _at(1)), ("b", _at(3)), ("c", _at(500))]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "repo_id string, ts timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("repo_id string, ts timestamp").parquet(source).withWatermark("ts", "10 seconds")
    out = triggers.debounce(stream, "repo_id", "ts").writeStream.format("memory").queryName("fires").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    batch = triggers.debounce(spark.createDataFrame(rows, "repo_id string, ts timestamp"), "repo_id", "ts")
    closed = sorted(map(tuple, batch.where("repo_id <> 'c'").collect()))  # the last session is still open
    assert sorted(map(tuple, spark.table("fires").collect())) == closed


def test_lock_of_a_stream_equals_the_batch(spark, tmp_path):
    rows = [("a", _at(t)) for t in (0, 3, 5, 9, 10)] + [("b", _at(1))]
    kind = "repo_id string, at timestamp"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(source)
    stream = triggers.lock_stream(spark.readStream.schema(kind).parquet(source), "repo_id", "at", 5_000_000)
    out = stream.writeStream.format("memory").queryName("locks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    batch = triggers.drop_while_running(spark.createDataFrame(rows, kind), "repo_id", "at", 5_000_000)
    assert sorted(map(tuple, spark.table("locks").collect())) == sorted(map(tuple, batch.collect()))


def test_paths(spark):
    names = ["a/b.TS", ".ts", "x.min.js", "x.d.ts", "a/node_modules/b.ts", "Makefile", None, "dist", "a.b/c", "q.hpp"]
    frame = spark.createDataFrame([(n,) for n in names], "p string")
    p = F.col("p")
    got = frame.select(paths.extension(p), paths.language(p), paths.has_noise_suffix(p), paths.in_noise_directory(p)).collect()
    assert [r[0] for r in got] == [".ts", "", ".js", ".ts", ".ts", "", None, "", "", ".hpp"]
    assert [r[1] for r in got] == ["typescript", None, "javascript", "typescript", "typescript", None, None, None, None, "cpp"]
    assert [r[2] for r in got][2:4] == [True, True] and [r[3] for r in got][4] is True and not got[7][3]
    url = spark.createDataFrame([("https://h/x/y.git",), ("git@h:x/z.git",), ("ftp://h/x",)], "u string")
    assert [tuple(r) for r in url.select(paths.repo_name(F.col("u")), paths.valid_url(F.col("u"))).collect()] == [("y", True), ("z", True), ("x", False)]


def test_text_functions(spark):
    row = spark.createDataFrame([("\t a😀'b \n",)], "t string")
    t = F.col("t")
    got = row.select(text_functions.strip(t), text_functions.utf16_length(t), text_functions.quoted(t), F.size(text_functions.lines(t)), text_functions.estimated_tokens(t)).first()
    assert tuple(got) == ("a😀'b", 9, "\t a😀''b \n", 2, 2)


def test_embedding_drops_failures(spark):
    rows = spark.createDataFrame([("load config file",), (None,), ("",)], "t string")
    assert embed_rows(rows, "t", HashingEmbedder(16)).count() == 1

    class Failing:
        model, dim = "failing", 2

        def embed(self, texts):
            raise RuntimeError

    assert embed_rows(rows, "t", Failing()).count() == 0
