"""Registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from pagetext.plans import edits, library, matching, regions, replies, runs, sources, spend, streams

_MODULES = (edits, library, matching, regions, replies, runs, sources, spend, streams)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
