"""Embedders (K4, K5): a protocol and a deterministic default.

The default hashes words and their neighbours into a vector. Its similarity is lexical, not
semantic; it makes runs reproducible where there is no model.
"""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")


class HashingEmbedder:
    """Signed feature hashing of lower-cased word parts and pairs of them, length 1."""

    def __init__(self, dim: int = 64):
        self.model, self.dim = f"hashing-{dim}", dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            words = [w.lower() for w in _PART.findall(text or "")]
            v = np.zeros(self.dim)
            for word in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                h = zlib.crc32(word.encode())
                v[(h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
            norm = float(np.sqrt(v @ v))
            out.append((v / norm).tolist() if norm else None)
        return out


def embed_rows(rows: DataFrame, text: str, embedder: Embedder, failed: str | None = None) -> DataFrame:
    """Input plus model, dim and vector; rows whose embedding is empty go (K4).

    Where a batch fails its texts are embedded one by one, so that only those that fail have no vector.
    Their rows go too, but stay with the flag ``failed`` where such a column is named.
    """

    @F.pandas_udf("vector array<float>, failed boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        listed = texts.fillna("").tolist()
        try:
            return pd.DataFrame({"vector": pd.Series(list(embedder.embed(listed)), dtype=object), "failed": [False] * len(listed)})
        except Exception:  # a failing text loses its row, not the batch or the run
            vectors, flags = [], []
            for one in listed:
                try:
                    vectors.append(embedder.embed([one])[0])
                    flags.append(False)
                except Exception:
                    vectors.append(None)
                    flags.append(True)
            return pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "failed": flags})

    done: Column = run(F.col(text))
    out = rows.withColumn("_cl_done", done).withColumns({"model": F.lit(embedder.model), "dim": F.lit(embedder.dim), "vector": F.col("_cl_done.vector")})
    if failed is None:
        return out.drop("_cl_done").where("vector IS NOT NULL AND size(vector) > 0")
    return out.withColumn(failed, F.col("_cl_done.failed")).drop("_cl_done").where(F.col(failed) | (F.col("vector").isNotNull() & (F.size("vector") > 0)))
