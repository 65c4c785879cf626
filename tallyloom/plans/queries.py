"""Queries over the reference's own operators, and the general operators of the core."""

from __future__ import annotations

from . import reference_queries, units_queries

_PARTS = [reference_queries, units_queries]


def queries() -> dict:
    return {k: v for m in _PARTS for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _PARTS for k, v in getattr(m, "SQL", {}).items()}
