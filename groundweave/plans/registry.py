"""All queries and their SQL, by name."""

from __future__ import annotations

from . import grid_queries, raster_queries, source_queries, vector_queries

MODULES = (grid_queries, raster_queries, vector_queries, source_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
