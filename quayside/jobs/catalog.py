"""All queries that run the library's operators over the given tables, with their SQL."""

from __future__ import annotations

from quayside.jobs import queries_basic, queries_exact, queries_history, queries_models, queries_stream, queries_tables  # noqa: F401  they register
from quayside.jobs.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
