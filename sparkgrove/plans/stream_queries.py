"""Queries that run a stream over a table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkgrove.plans.catalog_queries import _CHECK, _CTE
from sparkgrove.streaming import ingest


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All catalog entries through the ingest stream, with their verdicts."""
    return ingest.run_ingest(spark, f"{sf_dir}/folder_docs.parquet")


SQL = {"stream_ingest": f"{_CTE} SELECT entry_id, {_CHECK} AS verdict FROM fd"}
QUERIES = {"stream_ingest": stream_ingest}
