"""All registered queries and the SQL that they are held against."""

from __future__ import annotations

from . import diagram_queries, grid_queries, path_queries, point_queries, trajectory_queries  # noqa: F401  they register
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
