"""Registered queries: each reads whole supplied tables and, where SQL can say it, carries an equivalent DuckDB query."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, SQL

FAMILIES = [
    "profile", "rows", "metadata", "compare", "structure", "rollup",
    "localize", "signatures", "recommend", "sampling", "series", "streams", "privacy", "quarantine",
]


def load() -> tuple[dict, dict]:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
    return QUERIES, SQL
