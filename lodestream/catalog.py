"""All of the engine's own queries: name -> callable, and name -> SQL for DuckDB."""

from __future__ import annotations

from .plans import daily, quality, ranking, relational, selection, text  # noqa: F401  they register their queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
