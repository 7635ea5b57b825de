"""Queries and SQL of this package, for the entry module."""

from __future__ import annotations

from sparkgrove.llm import oracle, queries

QUERIES = queries.QUERIES
SQL = oracle.SQL
