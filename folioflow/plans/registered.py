"""All plain queries and their SQL by name."""

from __future__ import annotations

from folioflow.plans import file_queries, queries

QUERIES = queries.QUERIES
SQL = queries.SQL
MODULES = (queries, file_queries)
