"""Scalar functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(value: Column) -> Column:
    """Both ends without any white space (``trim`` removes spaces only)."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines separated by line feeds; a carriage return stays in its line."""
    return F.split(text, "\n", -1)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character outside the basic plane counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def signature(text: Column) -> Column:
    """First 200 characters of a symbol's source."""
    return F.substring(text, 1, 200)


def quoted(value: Column) -> Column:
    """Single quotes doubled, for literals in predicates that are passed on as text."""
    return F.replace(value, F.lit("'"), F.lit("''"))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def symbols_json(symbols: Column) -> Column:
    return F.to_json(symbols)
