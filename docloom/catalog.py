"""The registered queries and their SQL twins."""

from __future__ import annotations

from docloom.jobs.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
