"""Registered queries and their oracle SQL."""

from __future__ import annotations

from . import queries as _queries
from . import queries_analytic, queries_geometry, queries_more, queries_rom, queries_sampling, queries_tensors  # noqa: F401  (they register their queries)


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict:
    return dict(_queries.ORACLES)
