"""Catalog entries as a stream: each micro-batch is checked and split, and usage is summed over event-time windows.

The reference work has no streams; this is an extension, so that a folder can be filled while it is searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkgrove.operators import catalog as c
from sparkgrove.session import new_table_path


def read_entries(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """A stream of the parquet files in a folder, ``files`` of them per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def checked(entries: DataFrame) -> DataFrame:
    """Entries with the verdict of their checks."""
    return entries.withColumn("verdict", c.check_file(F.col("source_path"), F.col("filename"), F.col("file_hash"), F.col("total_pages")))


def ingest(entries: DataFrame, taken: str, checkpoint: str) -> StreamingQuery:
    """Writes each entry once, with its verdict, however often and late it is delivered.

    What was taken before is looked up in the table itself, by entry_id, so nothing is dropped for being late and no state grows in
    memory. A micro-batch that is repeated after a failure replaces its own files and sees only those of earlier ones.
    """

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.dropna(subset=["entry_id"]).dropDuplicates(["entry_id"])
        if number:
            before = batch.sparkSession.read.schema("entry_id long, part int").parquet(taken).filter(F.col("part") < number)
            rows = rows.join(before.select("entry_id"), "entry_id", "left_anti")
        rows.write.mode("overwrite").parquet(f"{taken}/part={number}")

    return checked(entries).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()


def windowed_usage(messages: DataFrame, width: str = "7 days", late: str = "2 days") -> DataFrame:
    """Messages per folder and window of sent_at; messages later than ``late`` after the newest one seen are dropped by the watermark."""
    rows = messages.withColumn("sent", F.col("sent_at").cast("timestamp")).withWatermark("sent", late)
    return rows.groupBy(F.window("sent", width), "folder_name").agg(F.count("*").alias("messages")).select(F.col("window.start").alias("window_start"), "folder_name", "messages")


def run_ingest(spark: SparkSession, path: str) -> DataFrame:
    """Streams a table of entries to its end; (entry_id, verdict) of all that were taken."""
    schema = spark.read.parquet(path).schema
    place = new_table_path(spark, "stream-ingest")
    ingest(read_entries(spark, path, schema), f"{place}/taken", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/taken").select("entry_id", "verdict")
