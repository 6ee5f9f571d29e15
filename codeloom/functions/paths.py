"""Path functions: extension, language, noise directories, repository names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".mjs": "javascript",
    ".py": "python",
    ".rs": "rust",
    ".go": "go",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".h": "cpp",
    ".hpp": "cpp",
}

# Directories that a walk never enters.
NOISE_DIRECTORIES = ("node_modules", ".git", "dist", "build", "target", "vendor", "__pycache__")

# Suffixes of files that are no sources.
NOISE_SUFFIXES = (".min.js", ".d.ts")

#: A path, in any case, ends in one of the extensions.
SOURCE_PATH_PATTERN = r"(?i)\.(ts|tsx|js|mjs|py|rs|go|cpp|cc|h|hpp)$"


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; ``''`` if there is none (``.ts`` alone has none)."""
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]*)$", 1))


def language(name: Column) -> Column:
    """Language label of a path, null for extensions that are not indexed."""
    pairs = [F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(name))


def in_noise_directory(path: Column) -> Column:
    """A directory of the path (its last part is the file) is a noise directory."""
    parts = F.split(path, "/")
    return F.arrays_overlap(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array(*[F.lit(x) for x in NOISE_DIRECTORIES]),
    )


def has_noise_suffix(path: Column) -> Column:
    out = F.lit(False)
    for suffix in NOISE_SUFFIXES:
        out = out | path.endswith(suffix)
    return out


def repo_name(url: Column) -> Column:
    """Last part of a repository's URL without ``.git``."""
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.git$", "")


def valid_url(url: Column) -> Column:
    return url.rlike(r"^(https?://|git@)\S+$")
