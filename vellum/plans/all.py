"""Every registered query, and the SQL that it is held against."""

from __future__ import annotations

from . import answers, ingest, queries, stored  # noqa: F401
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "answers", "ingest"]
