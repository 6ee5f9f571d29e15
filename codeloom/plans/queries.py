"""Registered queries of the core and their SQL."""

from __future__ import annotations

from codeloom.plans import bundles, changes, feeds, graphs, symbols, vectors

_MODULES = (vectors, symbols, graphs, bundles, feeds, changes)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
FLAGSHIP = "vector_search"
