"""All queries of the library's own operators."""

from __future__ import annotations

from plinth.plans import cluster_queries, event_queries, reading_queries, relational_queries, section_queries, sheet_queries, signal_queries, spatial_queries  # noqa: F401
from plinth.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
