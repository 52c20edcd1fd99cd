"""Registry of the review queries and their DuckDB counterparts."""

from __future__ import annotations

from palimpsest.plans import document_queries, locator_queries, model_queries, record_queries, session_queries, store_queries, text_queries  # noqa: F401  (they register themselves)
from palimpsest.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
