from sparkgrove.session import new_table_path
from sparkgrove.streaming import ingest

SCHEMA = "entry_id long, source_path string, filename string, file_hash string, total_pages int, indexed_at timestamp_ntz"


def test_repeats_in_later_and_late_files_count_once(spark):
    path = new_table_path(spark, "entries")
    rows = [(i, "p" if i % 3 else None, "a.pdf", None, 3, None) for i in range(30)]
    for part in (rows[:20], rows[10:], rows[:5], rows[:0]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    found = ingest.run_ingest(spark, path).collect()
    assert sorted((r.entry_id, r.verdict) for r in found) == [(i, "ok" if i % 3 else "not_found") for i in range(30)]


def test_usage_by_window(spark, data):
    path = new_table_path(spark, "messages")
    spark.read.parquet(f"{data}/chat_messages.parquet").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = ingest.windowed_usage(stream).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.sql("select sum(messages) as n, count(*) as windows from usage").first()
    assert rows.n == spark.read.parquet(path).filter("sent_at is not null").count() and rows.windows > 1
