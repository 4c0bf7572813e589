"""All registered queries and their DuckDB twins, by name."""

from __future__ import annotations

from . import cvs, documents, nested, reports, rows, tables
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "cvs", "documents", "nested", "reports", "rows", "tables"]
