"""Joins that a hot key does not gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: list[Column], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join of a table that may be skewed on ``keys`` with one of few rows per key.

    Rows of ``many`` are spread over ``salts`` parts of their key by ``spread``; rows of ``few`` are
    repeated once per part. ``how``: inner, left, left_semi or left_anti.
    """
    left = many.withColumn("_cl_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = few.withColumn("_cl_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_cl_salt"], how).drop("_cl_salt")
