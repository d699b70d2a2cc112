"""All queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from . import documents, evaluation, instructions, loading, mixture, runs, storage, streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (documents, instructions, loading, mixture, runs, evaluation, storage, streams):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
