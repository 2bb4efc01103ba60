"""All registered queries of the library's core."""

from __future__ import annotations

from importlib import import_module

#: Modules of ``paperloom.plans`` that have queries.
MODULES = ["hierarchy", "nested", "library", "sessions", "quality", "documents", "retrieval", "texts", "lookups", "anchors", "writes", "streams"]


def queries() -> dict:
    """Name -> function of a session and a folder of parquet tables."""
    return {k: v for m in MODULES for k, v in import_module(f"paperloom.plans.{m}").queries().items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB text with the same result, where SQL can express it."""
    return {k: v for m in MODULES for k, v in import_module(f"paperloom.plans.{m}").oracle_sql().items()}
