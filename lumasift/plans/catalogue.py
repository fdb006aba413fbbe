"""All queries by name, with their DuckDB oracles (None where SQL can't express one)."""

from __future__ import annotations

from lumasift.plans import audits, decision, files, graphs, more, pictures, queue, records, stats, streams, tables, urls_text

_MODULES = (decision, urls_text, queue, stats, graphs, streams, more, records, pictures, audits, tables, files)


def _all() -> dict:
    return {name: pair for module in _MODULES for name, pair in module.QUERIES.items()}


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracles() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
