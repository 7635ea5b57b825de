"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkgrove.plans import catalog_queries, chat_queries, data_queries, library_queries, search_queries, stream_queries, tree_queries

_MODULES = (search_queries, catalog_queries, tree_queries, chat_queries, data_queries, library_queries, stream_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["ask_routed"](spark, sf_dir)
