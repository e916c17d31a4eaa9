"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import analytics, answers, knowledge, retrieval, states, vectors  # noqa: F401 (they register their queries)
from .registry import QUERIES, SQL

FLAGSHIP = "search_bm25_documents"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
