"""The engine's surface: registry, indexing, search, look-up, bundles."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.functions.embed import Embedder, HashingEmbedder, embed_rows
from codeloom.operators import bundle, changes, chunking, graph, lookup, search
from codeloom.parsing.extract import parse_files
from codeloom.session import cut_lineage, ship_package
from codeloom.sources import registry
from codeloom.sources.progress import Progress
from codeloom.sources.tables import Tables
from codeloom.sources.walk import MAX_FILE_BYTES, read_files, walk_repo

_NODES = {
    "functions": ("function", schemas.FUNCTIONS),
    "classes": ("class", schemas.CLASSES),
    "types": ("type", schemas.TYPES),
    "imports": ("import", schemas.IMPORTS),
}


class ModelMismatch(ValueError):
    """Stored vectors come from another model than the query's; their scores would mean nothing."""


class UnknownRepo(LookupError):
    """No repository of that name; the message lists the known ones."""


@dataclass
class IndexResult:
    mode: str
    files_processed: int = 0
    files_deleted: int = 0
    symbols_extracted: int = 0
    edges_attempted: int = 0
    edges_created: int = 0
    embeddings_stored: int = 0
    embeddings_failed: int = 0
    failed_files: list[tuple[str, str]] = field(default_factory=list)


class Engine:
    """Code knowledge of several repositories in one folder of tables."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None):
        ship_package(spark)
        self.spark, self.tables, self.embedder = spark, Tables(spark, root), embedder or HashingEmbedder()
        self._registry = f"{root.rstrip('/')}/repos"

    # registry

    def repos(self) -> DataFrame:
        if not self.tables.exists("repos"):
            return self.spark.createDataFrame([], schemas.REPOS)
        return self.spark.read.schema(schemas.REPOS).parquet(self._registry)

    def _store_repos(self, repos: DataFrame) -> None:
        rows = repos.collect()  # the registry: one row per repository of this engine
        self.spark.createDataFrame(rows, schemas.REPOS).coalesce(1).write.mode("overwrite").parquet(self._registry)

    def list_repos(self) -> DataFrame:
        return self.repos().select("id", "name", "url", "branch")

    def add_repo(self, url: str, name: str | None = None, branch: str = "main") -> str:
        repos, new = registry.add(self.spark, self.repos(), url, name, branch)
        self._store_repos(repos)
        return new

    def remove_repo(self, repo_id: str, purge: bool = False) -> None:
        self._store_repos(registry.remove(self.repos(), repo_id))
        if purge:
            for name in self.tables.names():
                if name != "repos":
                    self.tables.drop_partition(name, repo_id)

    def _targets(self, repo_name: str | None, repo_id: str | None) -> DataFrame:
        targets = registry.resolve(self.repos(), repo_name, repo_id)
        if repo_id is None and repo_name is not None and targets.isEmpty():
            known = ", ".join(sorted(r["name"] for r in self.repos().select("name").collect()))
            raise UnknownRepo(f"no repository named {repo_name!r}; known: {known}")
        return targets.select(F.col("id").alias("repo_id"))

    # indexing

    def index(
        self, repo_id: str, root: str, mode: str = "full", head: str | None = None, changed: DataFrame | None = None,
        max_file_bytes: int = MAX_FILE_BYTES, batch_files: int | None = None,
    ) -> IndexResult:
        """Indexes a checkout.

        ``incremental`` needs ``changed`` (status, path, old_path) and falls back to a full run
        without a baseline; ``resume`` skips files of the checkpoint. The files are one plan; with
        ``batch_files`` they are written in batches of that many, each with its checkpoint, so that a
        run that fails can be resumed.
        """
        state = self.checkpoint(repo_id)
        chosen = changes.run_mode(mode, state.last_commit if state else None, head, True)
        if chosen == "incremental" and changed is None:
            chosen = "full"
        result, log = IndexResult(chosen), Progress(self.spark, self.tables, repo_id)
        if chosen == "none":
            return result
        log.report("repo:started", mode=chosen)
        try:
            self._run(result, log, state, repo_id, root, changed, max_file_bytes, batch_files)
            self._write_checkpoint(repo_id, None, head)
            log.report("repo:completed", files=result.files_processed, symbols=result.symbols_extracted)
        except Exception as error:
            log.report("repo:failed", reason=type(error).__name__)
            raise
        finally:
            log.flush()
        return result

    def index_all(self, roots: dict[str, str], mode: str = "full") -> dict[str, IndexResult]:
        """Indexes every registered repository whose checkout is given; one that fails stops no other."""
        out = {}
        for row in self.repos().select("id").collect():
            if row["id"] in roots:
                try:
                    out[row["id"]] = self.index(row["id"], roots[row["id"]], mode)
                except Exception as error:
                    out[row["id"]] = IndexResult("failed", failed_files=[("", str(error)[:200])])
        return out

    def _run(self, result: IndexResult, log: Progress, state, repo_id: str, root: str, changed: DataFrame | None, max_file_bytes: int, batch_files: int | None) -> None:
        files = read_files(walk_repo(self.spark, root, repo_id, max_file_bytes, result.failed_files))
        gone, done = None, []
        if result.mode == "resume" and state and state.processed_files:
            done = list(state.processed_files)
            listed = self.spark.createDataFrame([(p,) for p in done], "relative_path string")
            files = files.join(listed, "relative_path", "left_anti")
            gone = files.select("repo_id", F.col("relative_path").alias("file_path"))
        elif result.mode == "incremental":
            delta = changes.indexed(changed.withColumn("repo_id", F.lit(repo_id)))
            result.files_deleted = delta.where("status IN ('D', 'R')").count()
            gone = changes.touched(delta)
            files = files.join(gone.select(F.col("file_path").alias("relative_path")), "relative_path", "left_semi")
        files = cut_lineage(files)
        for path, reason in [(r[0], "unreadable") for r in files.where("content IS NULL").select("relative_path").collect()]:
            result.failed_files.append((path, reason))
        for path, reason in result.failed_files:
            log.report("file:skipped" if reason == "too-large" else "file:failed", path=path, reason=reason)
        files = files.where("content IS NOT NULL")
        result.files_processed = files.count()
        if batch_files:
            # Only the paths are numbered in one order; the contents stay where they are.
            order = files.select("relative_path").withColumn("_cl_batch", F.floor((F.row_number().over(_rank("relative_path")) - 1) / batch_files))
            numbered = cut_lineage(files.join(order, "relative_path"))
            if gone is None:
                for name in (*_NODES, "file_nodes", "call_sites", "embeddings", "contains", "has_method"):
                    self.tables.drop_partition(name, repo_id)
            else:
                self._index_files(result, log, files.limit(0), repo_id, gone)
            for k in range(-(-result.files_processed // batch_files)):
                batch = numbered.where(F.col("_cl_batch") == k).drop("_cl_batch")
                self._index_files(result, log, batch, repo_id, batch.select("repo_id", F.col("relative_path").alias("file_path")))
                done += [r[0] for r in batch.select("relative_path").collect()]
                self._write_checkpoint(repo_id, sorted(done), None)
                log.report("batch:committed", batch=k, files=len(done))
        else:
            self._index_files(result, log, files, repo_id, gone)
        # Edges come from the stored call sites, so an incremental run equals a full one.
        mine = F.col("repo_id") == repo_id
        functions = self.tables.read("functions", schemas.FUNCTIONS).where(mine)
        stored = self.tables.read("call_sites", schemas.CALL_SITES).where(mine)
        result.edges_attempted = graph.resolve_calls(stored, functions).where("callee_file IS NOT NULL").count()
        result.edges_created = self._write("call_edges", schemas.CALL_EDGES, graph.call_edges(stored, functions), repo_id, None)
        log.report("edges:resolved", attempted=result.edges_attempted, distinct=result.edges_created)

    def _index_files(self, result: IndexResult, log: Progress, files: DataFrame, repo_id: str, gone: DataFrame | None) -> None:
        """Parses files once and replaces the rows of the files in ``gone`` (of all, if null)."""
        symbols = cut_lineage(parse_files(files))
        result.symbols_extracted += symbols.where("kind <> 'call'").count()
        self._write("file_nodes", schemas.FILE_NODES, files.select("repo_id", F.col("relative_path").alias("file_path"), "language"), repo_id, gone)
        nodes = {}
        for name, (kind, schema) in _NODES.items():
            nodes[kind] = graph.last_wins(symbols.where(F.col("kind") == kind), graph.NODE_KEYS[kind], [F.col("ordinal")])
            self._write(name, schema, nodes[kind], repo_id, gone)
        own = files.select("repo_id", F.col("relative_path").alias("file_path"))
        held = symbols.where("kind <> 'call'").select("repo_id", "file_path", "kind", F.when(F.col("kind") == "import", F.col("module_path")).otherwise(F.col("name")).alias("name"))
        self._write("contains", schemas.CONTAINS, graph.contains(own, held), repo_id, gone)
        self._write("has_method", schemas.HAS_METHOD, graph.has_method(nodes["class"], nodes["function"]), repo_id, gone)
        sites = symbols.where("kind = 'call'").select("repo_id", "file_path", F.col("name").alias("callee_name"), "caller_name", "ordinal")
        self._write("call_sites", schemas.CALL_SITES, sites, repo_id, gone)
        pieces = chunking.extract_chunks(files.withColumnRenamed("relative_path", "file_path"), symbols)
        embedded = cut_lineage(embed_rows(pieces, "source_text", self.embedder, failed="_cl_failed"))
        for path, count in sorted(tuple(r) for r in embedded.where("_cl_failed").groupBy("file_path").count().collect()):
            result.embeddings_failed += count
            result.failed_files.append((path, "embedding"))
            log.report("file:failed", path=path, reason="embedding", chunks=count)
        embedded = embedded.where("NOT _cl_failed").drop("_cl_failed")
        result.embeddings_stored += embedded.count()
        self._write("embeddings", schemas.EMBEDDINGS, embedded, repo_id, gone)

    def _write(self, name: str, schema: str, fresh: DataFrame, repo_id: str, gone: DataFrame | None) -> int:
        columns = self.spark.createDataFrame([], schema).columns
        rows = fresh.select(*columns)
        if gone is not None:
            old = self.tables.read(name, schema).where(F.col("repo_id") == repo_id)
            rows = old.join(gone, ["repo_id", "file_path"], "left_anti").unionByName(rows)
        if "name" in columns:  # narrow value ranges per row group serve look-ups by name
            rows = rows.sortWithinPartitions("name")
        rows = cut_lineage(rows)
        if rows.isEmpty():
            self.tables.drop_partition(name, repo_id)
            return 0
        self.tables.replace_partitions(name, rows)
        return rows.count()

    # checkpoints

    def checkpoint(self, repo_id: str):
        rows = self.tables.read("checkpoints", schemas.CHECKPOINTS).where(F.col("repo_id") == repo_id).collect()
        return rows[0] if rows else None

    def _write_checkpoint(self, repo_id: str, processed: list[str] | None, head: str | None) -> None:
        old = self.checkpoint(repo_id)
        row = (repo_id, processed, head if head is not None else old.last_commit if old else None, datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))
        self.tables.replace_partitions("checkpoints", self.spark.createDataFrame([row], schemas.CHECKPOINTS))

    def mark_processed(self, repo_id: str, paths: list[str]) -> None:
        old = self.checkpoint(repo_id)
        self._write_checkpoint(repo_id, sorted({*(old.processed_files or [] if old else []), *paths}), None)

    # queries

    def search(
        self, query: str, repo_name: str | None = None, repo_id: str | None = None, k: int = search.TOP_K, min_score: float = search.MIN_SCORE,
        language: str | None = None, symbol_type: str | None = None,
    ) -> DataFrame:
        """Ranked chunks: filter, top k, threshold."""
        if symbol_type is not None and symbol_type not in ("function", "class", "type"):
            raise ValueError(f"{symbol_type!r} is no kind of symbol")
        rows = self.tables.read("embeddings", schemas.EMBEDDINGS)
        rows = rows.join(self._targets(repo_name, repo_id), "repo_id", "left_semi")
        foreign = rows.where((F.col("model") != self.embedder.model) | (F.col("dim") != self.embedder.dim)).select("model").limit(1).collect()
        if foreign:
            raise ModelMismatch(f"stored vectors are of {foreign[0]['model']!r}, the query's of {self.embedder.model!r}")
        vector = self.embedder.embed([query])[0]
        if vector is None:
            return rows.limit(0).withColumn("score", F.lit(0.0)).drop("vector")
        keyed = rows.withColumn("_cl_key", F.struct("repo_id", "file_path", "start_line", "symbol_name"))
        found = search.vector_search(keyed, vector, "vector", "_cl_key", search.metadata_filter(None, language, symbol_type), k, min_score)
        return found.drop("vector", "_cl_key")

    def lookup(self, name: str, repo_name: str | None = None, repo_id: str | None = None) -> DataFrame:
        """Symbols of that name, else of that prefix, with text, callers and callees."""
        targets = self._targets(repo_name, repo_id)
        columns = ["repo_id", "file_path", "name", "start_line", "end_line", "language", "ordinal"]
        kinds = [(kind, self.tables.read(table, schema).select(*columns)) for table, (kind, schema) in _NODES.items() if kind != "import"]
        symbols = lookup.in_repositories(lookup.tagged(kinds), self.repos()).join(targets, "repo_id", "left_semi")
        hits = cut_lineage(lookup.exact_else_prefix(symbols, name))
        asked = hits.select("repo_id", "file_path", F.col("name").alias("base_name")).distinct()
        # Texts of the hits only; the rest of the table is neither shuffled nor aggregated.
        stored = self.tables.read("embeddings", schemas.EMBEDDINGS).join(asked, ["repo_id", "file_path", "base_name"], "left_semi")
        texts = stored.groupBy("repo_id", "file_path", F.col("base_name").alias("name")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "source_text"))), lambda x: x["source_text"]), "\n").alias("source_text")
        )
        functions = self.tables.read("functions", schemas.FUNCTIONS)
        edges = self.tables.read("call_edges", schemas.CALL_EDGES)
        return lookup.ordered(lookup.expand(hits, texts, edges, functions), self.repos())

    def bundle(self, task: str, repo_name: str | None = None, repo_id: str | None = None, max_tokens: int = bundle.DEFAULT_TOKENS) -> str:
        """Markdown of the best chunks for a task and of code that calls them or is called."""
        budget = bundle.budget_chars(max_tokens)
        hits = self.search(task, repo_name, repo_id, k=bundle.SEEDS).withColumn("rank", F.row_number().over(_rank()))
        hits = hits.withColumn("grp", F.lit(1))
        seeds = bundle.fill_seeds(
            bundle.first_occurrences(hits, ["grp"], ["repo_id", "file_path", "symbol_name"], [F.col("rank")]), ["grp"], [F.col("rank")], F.length("source_text"), budget
        )
        seeds = cut_lineage(seeds)
        edges = self.tables.read("call_edges", schemas.CALL_EDGES)
        targets = seeds.select("repo_id", F.col("base_name").alias("name"), "file_path")
        near = cut_lineage(graph.neighbors(edges, targets))
        texts = self.tables.read("embeddings", schemas.EMBEDDINGS).select(
            "repo_id", F.col("file_path").alias("neighbor_file"), F.col("base_name").alias("neighbor"), F.col("source_text").alias("text"), F.col("start_line").alias("n_line")
        ).join(near.select("repo_id", "neighbor_file", "neighbor").distinct(), ["repo_id", "neighbor_file", "neighbor"], "left_semi")
        one = texts.groupBy("repo_id", "neighbor_file", "neighbor").agg(F.min(F.struct("n_line", "text"))["text"].alias("text"))
        seed_of = seeds.select("repo_id", F.col("base_name").alias("name"), "file_path", "rank", F.col("language").alias("seed_language"))
        related = (
            near.join(seed_of, ["repo_id", "name", "file_path"])
            .join(one, ["repo_id", "neighbor_file", "neighbor"], "left")
            .join(seeds.select("repo_id", F.col("file_path").alias("neighbor_file"), F.col("base_name").alias("neighbor")), ["repo_id", "neighbor_file", "neighbor"], "left_anti")
            .withColumn("grp", F.lit(1))
            .withColumn("order", F.struct("rank", F.when(F.col("relation") == "caller", 0).otherwise(1).alias("side"), "neighbor", "neighbor_file"))
        )
        related = bundle.first_occurrences(related, ["grp"], ["repo_id", "neighbor_file", "neighbor"], [F.col("order")])
        related = cut_lineage(related.withColumn("item", F.row_number().over(_rank("order")).cast("long")))
        filled = bundle.fill_related(related, seeds, ["grp"], F.col("item").cast("int"), "item", F.length(F.coalesce("text", F.lit(""))), budget)
        kept = filled.select(F.explode("related").alias("item"))
        lines = seeds.select(
            F.lit("seed").alias("section"),
            "rank",
            bundle.format_chunk(F.col("symbol_name"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("language"), F.col("source_text"), F.lit(None).cast("string")).alias("markdown"),
        ).unionByName(
            related.join(kept, "item").select(
                F.lit("related").alias("section"),
                F.col("item").cast("int").alias("rank"),
                bundle.format_chunk(
                    F.col("neighbor"), F.col("neighbor_file"), F.lit(0), F.lit(0), F.col("seed_language"), F.col("text"), F.concat(F.col("relation"), F.lit(" of "), F.col("name"))
                ).alias("markdown"),
            )
        )
        return bundle.format_bundle(lines).first()["bundle"]

    def health(self) -> bool:
        """The session answers, and the registry and the tables of the index can be read."""
        tables = [(name, schema) for name, (_, schema) in _NODES.items()] + [("call_edges", schemas.CALL_EDGES), ("embeddings", schemas.EMBEDDINGS)]
        readable = all(self.tables.read(name, schema).limit(1).count() >= 0 for name, schema in tables)
        return self.spark.sql("SELECT 1").first()[0] == 1 and self.repos().limit(1).count() >= 0 and readable

    def stats(self) -> dict[str, int]:
        """Row counts of all tables."""
        out = {name: self.tables.read(name, schema).count() for name, (_, schema) in _NODES.items()}
        out["repos"] = self.repos().count()
        for name, schema in (("call_edges", schemas.CALL_EDGES), ("contains", schemas.CONTAINS), ("has_method", schemas.HAS_METHOD)):
            out[name] = self.tables.read(name, schema).count()
        out["embeddings"] = self.tables.read("embeddings", schemas.EMBEDDINGS).count()
        return out


def _rank(order: str = "score"):
    from pyspark.sql import Window

    if order == "score":
        return Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "repo_id", "file_path", "start_line")
    return Window.partitionBy(F.lit(1)).orderBy(order)
