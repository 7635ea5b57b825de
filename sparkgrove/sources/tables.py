"""Readers that give each table once per key, whatever was delivered twice or late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that identify a row of each table.
KEYS = {
    "folders": ["folder_name"],
    "folder_docs": ["entry_id"],
    "doc_index": ["document_id"],
    "index_records": ["record_id"],
    "chat_messages": ["conv_id", "turn"],
    "documents": ["doc_id"],
    "mix_targets": ["mix_name", "source"],
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as delivered, repeats included."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_once(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, one row per key; rows whose key is null are left out.

    Repeats are identical in every column, so any one of them may stay.
    """
    key = KEYS[name]
    rows = load(spark, sf_dir, name)
    if columns:
        rows = rows.select(*dict.fromkeys([*key, *columns]))
    return rows.dropna(subset=key).dropDuplicates(key)


def latest(rows: DataFrame, key: list[str], by: str, columns: list[str]) -> DataFrame:
    """Per key the values of the row with the greatest ``by``.

    A null ``by`` counts as the earliest; rows that tie are decided by their values in the order of
    ``columns``, so that the result doesn't depend on partitioning. It is one aggregation with
    map-side combining, not a window over all versions of a key.
    """
    best = rows.groupBy(*key).agg(F.max(F.struct(by, *columns)).alias("_best"))
    return best.select(*key, *[F.col("_best")[c].alias(c) for c in columns])


def current_nodes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Current rows of tree_nodes: of each (document_id, node_id) the one loaded last."""
    rows = load(spark, sf_dir, "tree_nodes").dropna(subset=["document_id", "node_id"])
    return latest(rows, ["document_id", "node_id"], "loaded_at", list(columns))


def known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, total_pages) of the indexed documents whose number of pages is known and positive."""
    rows = load(spark, sf_dir, "doc_index").select("document_id", "total_pages")
    return rows.filter("document_id is not null and total_pages > 0").groupBy("document_id").agg(F.max("total_pages").alias("total_pages"))


def clip_pages(start: Column, end: Column, total: Column) -> tuple[Column, Column]:
    """Reversed ranges put in order and cut to pages 0 .. total - 1; first > last where no page is left.

    A range with a null bound gives nulls.
    """
    known = start.isNotNull() & end.isNotNull()
    first, last = F.greatest(F.least(start, end), F.lit(0)), F.least(F.greatest(start, end), total - 1)
    return F.when(known, first), F.when(known, last)
