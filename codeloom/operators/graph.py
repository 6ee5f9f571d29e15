"""Property graph of symbols as tables: nodes, edges, call resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of the node tables.
NODE_KEYS = {
    "file": ["repo_id", "file_path"],
    "function": ["repo_id", "name", "file_path", "class_name"],
    "class": ["repo_id", "name", "file_path"],
    "type": ["repo_id", "name", "file_path"],
    "import": ["repo_id", "module_path", "file_path"],
}


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order``.

    An aggregation with a partial step per task, so a hot key costs one row per task, not a sort of
    its rows. Null keys form a group of their own.
    """
    rest = [c for c in rows.columns if c not in keys]
    latest = F.max(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_cl")
    return rows.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"_cl._row.{c}").alias(c) for c in rest])


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_cl")
    return rows.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_cl._row.{c}").alias(c) for c in rows.columns])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column], keep_on_match: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows replaced by incoming ones of the same key; new keys added.

    ``keep_on_match`` columns keep their existing value on a match (a function's language).
    """
    fresh = last_wins(incoming, keys, order)
    old = existing.select(*keys, *[F.col(c).alias(f"_cl_{c}") for c in keep_on_match], F.lit(True).alias("_cl_old"))
    merged = fresh.join(old, keys, "left") if keep_on_match else fresh
    for c in keep_on_match:
        merged = merged.withColumn(c, F.when(F.col("_cl_old"), F.col(f"_cl_{c}")).otherwise(F.col(c)))
    untouched = existing.join(fresh.select(*keys), keys, "left_anti")
    return untouched.unionByName(merged.select(*existing.columns))


def contains(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """File to symbol edges, as a set."""
    return symbols.join(files.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_semi").select("repo_id", "file_path", "kind", "name").distinct()


def has_method(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Class to method edges; the class has to be in the same file."""
    methods = functions.where("class_name <> ''").select("repo_id", "file_path", "class_name", F.col("name").alias("method"))
    owners = classes.select("repo_id", "file_path", F.col("name").alias("class_name"))
    return methods.join(owners, ["repo_id", "file_path", "class_name"]).distinct()


def first_function(functions: DataFrame) -> DataFrame:
    """The function that calls of a file are attributed to: the first emitted."""
    first = F.min(F.struct("ordinal", "name", "class_name")).alias("f")
    return functions.groupBy("repo_id", "file_path").agg(first).select("repo_id", "file_path", F.col("f.name").alias("name"), F.col("f.class_name").alias("class_name"))


def resolve_calls(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Candidates of call sites (J4, A7): same-file functions of the name, else all of the repository.

    ``sites``: repo_id, file_path, callee_name; ``functions``: repo_id, file_path, name. Two chained
    left joins, so a site with s same-file and r repository-wide hits gives s * r rows (at least
    one each); unresolved sites have a null callee_file. Names are hashed with the repository, so a
    hot repository spreads over its names.
    """
    names = sites.where("callee_name IS NOT NULL").select("repo_id", "file_path", "callee_name").distinct()
    own = functions.select("repo_id", "file_path", F.col("name").alias("callee_name"), F.col("file_path").alias("own_file"))
    wide = functions.select("repo_id", F.col("name").alias("callee_name"), F.col("file_path").alias("wide_file"))
    return (
        names.join(own, ["repo_id", "file_path", "callee_name"], "left")
        .join(wide, ["repo_id", "callee_name"], "left")
        .select("repo_id", "file_path", "callee_name", F.coalesce("own_file", "wide_file").alias("callee_file"))
    )


def call_edges(sites: DataFrame, functions: DataFrame, attribution: str = "first") -> DataFrame:
    """Distinct edges (U7): repo_id, caller_name, caller_file, callee_name, callee_file, cross_file.

    ``attribution="first"``: all calls of a file belong to its first function; ``"enclosing"``:
    to the function that the extractor recorded as ``caller_name``.
    """
    targets = resolve_calls(sites, functions).where("callee_file IS NOT NULL").distinct()
    if attribution == "enclosing":
        callers = sites.where("caller_name IS NOT NULL").select("repo_id", "file_path", "callee_name", "caller_name").distinct()
        joined = targets.join(callers, ["repo_id", "file_path", "callee_name"])
    else:
        callers = first_function(functions).select("repo_id", "file_path", F.col("name").alias("caller_name"))
        joined = targets.join(callers, ["repo_id", "file_path"])
    return joined.select(
        "repo_id",
        "caller_name",
        F.col("file_path").alias("caller_file"),
        "callee_name",
        "callee_file",
        (F.col("file_path") != F.col("callee_file")).alias("cross_file"),
    ).distinct()


def neighbors(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Callers and callees of targets (repo_id, name, file_path), tagged."""
    wanted = targets.select("repo_id", "name", "file_path").distinct()

    def side(own: str, other: str) -> DataFrame:
        keyed = edges.select(
            "repo_id", F.col(f"{own}_name").alias("name"), F.col(f"{own}_file").alias("file_path"), F.col(f"{other}_name").alias("neighbor"), F.col(f"{other}_file").alias("neighbor_file")
        )
        return keyed.join(wanted, ["repo_id", "name", "file_path"]).withColumn("relation", F.lit(other))

    return side("callee", "caller").unionByName(side("caller", "callee"))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of the files in ``gone`` (repo_id, file_path), and edges without any that
    touches such a file at either end (J11, U9)."""
    files = gone.select("repo_id", "file_path").distinct()
    left = nodes.join(files, ["repo_id", "file_path"], "left_anti")
    kept = edges
    for end in ("caller_file", "callee_file"):
        kept = kept.join(files.select("repo_id", F.col("file_path").alias(end)), ["repo_id", end], "left_anti")
    return left, kept
