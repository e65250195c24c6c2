"""All queries of the core library and their SQL counterparts."""

from __future__ import annotations

from . import case_queries  # noqa: F401  (registers the queries over case tables)
from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = "a9_confusion"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
