from pyspark.sql import functions as F

from sparkgrove.operators import catalog as c
from sparkgrove.operators import pages
from sparkgrove.sources import tables as t


def test_checks_come_in_order(spark):
    rows = [
        (None, "a.pdf", "x", 1, "not_found"), (" ", "a.pdf", "x", 1, "not_found"), ("p", "a.txt", "x", 1, "not_pdf"), ("p", None, "x", 1, "not_pdf"), ("p", "A.PDF", c.EMPTY_FILE.upper(), 1, "empty_file"),
        ("p", "a.pdf", None, None, "corrupt"), ("p", "a.pdf", None, 0, "no_pages"), ("p", "a.pdf", None, c.TOO_LARGE + 1, "too_large"), ("p", "a.pdf", None, 5, "ok"),
    ]
    frame = spark.createDataFrame(rows, "path string, name string, hash string, pages int, want string")
    found = frame.select(c.check_file(F.col("path"), F.col("name"), F.col("hash"), F.col("pages")), "want").collect()
    assert all(r[0] == r[1] for r in found)


def test_names(spark):
    names = [("ok", "ok"), ("", "blank"), (None, "blank"), ("a/b", "bad_character"), ("x" * 201, "too_long"), ("..", "ok")]
    rows = spark.createDataFrame(names, "name string, want string").select(c.check_name(F.col("name")), "want")
    assert all(r[0] == r[1] for r in rows.collect())


def test_upsert_keeps_the_last_and_remove_drops_all(spark):
    rows = spark.createDataFrame([(1, "f", "a"), (2, "f", "b"), (3, "f", "a")], "entry_id long, folder_name string, filename string")
    assert {(r.filename, r.entry_id, r.versions) for r in c.upsert(rows).collect()} == {("a", 3, 2), ("b", 2, 1)}
    assert [r.entry_id for r in c.remove(rows, rows.filter("entry_id = 3")).collect()] == [2]


def test_health_and_repair(spark):
    catalog = spark.createDataFrame([("f", "1", "a", None, "h"), ("f", "2", "b", "p", "h"), ("f", "3", "c", "p", "h"), ("f", "4", "d", "p", "0" * 32)], "folder_name string, document_id string, filename string, pdf_path string, file_hash string")
    index = spark.createDataFrame([("f", "3", "c", None), ("f", "4", "d", "1" * 32), ("f", "9", "z", None)], "folder_name string, document_id string, filename string, file_hash string")
    found = {r.document_id: r.status for r in c.health(catalog, index).collect()}
    assert found == {"1": "missing_pdf", "2": "missing_index", "3": "healthy", "4": "stale", "9": "orphan"}
    assert {r.action for r in c.repair(c.health(catalog, index), remove_broken=True).collect()} == {"remove_entry", "reindex", "delete_index"}


def test_time_ago(spark):
    times = [(None, "unknown"), ("2024-01-09 23:59:30", "just now"), ("2024-01-09 23:01:00", "59m ago"), ("2024-01-09 01:00:00", "23h ago"), ("2024-01-01 00:00:00", "9d ago")]
    rows = spark.createDataFrame(times, "t string, want string").select(c.time_ago(F.col("t").cast("timestamp"), "2024-01-10 00:00:00"), "want")
    assert all(r[0] == r[1] for r in rows.collect())


def test_latest_versions_and_ties(spark):
    rows = spark.createDataFrame([("a", None, 5), ("a", "2024-01-02", 1), ("a", "2024-01-02", 2), ("b", None, None)], "k string, at string, v int")
    assert {(r.k, r.v) for r in t.latest(rows, ["k"], "at", ["v"]).collect()} == {("a", 2), ("b", None)}


def test_sections_by_headings(spark):
    rows = spark.createDataFrame([(1, "Some text before it.\nScope\nText one.\nText two.\nResults of 2024\nEnd."), (2, ""), (3, None)], "doc_id long, text string")
    found = {(r.doc_id, r.title, r.start_page, r.end_page) for r in pages.sections(pages.split_pages(rows, "doc_id", "text"), "doc_id").collect()}
    assert found == {(1, "Document", 0, 0), (1, "Scope", 1, 3), (1, "Results of 2024", 4, 5), (2, "Document", 0, 0)}
