from pyspark.sql import functions as F

from sparkgrove.operators import chat, tree
from sparkgrove.sources import tables as t


def test_pages_are_put_in_order_and_cut(spark):
    rows = [(5, 2, 10, (2, 5)), (-3, 4, 10, (0, 4)), (8, 20, 10, (8, 9)), (12, 15, 10, (12, 9)), (None, 3, 10, (None, None))]
    frame = spark.createDataFrame([(*r[:3], *r[3]) for r in rows], "s int, e int, n int, a int, b int")
    first, last = t.clip_pages(F.col("s"), F.col("e"), F.col("n"))
    assert all((r.first, r.last) == (r.a, r.b) for r in frame.select(first.alias("first"), last.alias("last"), "a", "b").collect())


def test_current_rows_do_not_depend_on_partitions(spark, data):
    once = t.current_nodes(spark, data, "title", "start_page")
    spread = t.latest(spark.read.parquet(f"{data}/tree_nodes.parquet").repartition(7), ["document_id", "node_id"], "loaded_at", ["title", "start_page"])
    assert sorted(map(str, once.collect())) == sorted(map(str, spread.collect()))


def test_batches_cover_all_pages(spark):
    for size, overlap in ((15, 2), (2, 1), (5, 0)):
        pages = spark.createDataFrame([(str(n), n) for n in (1, 2, 14, 15, 16, 27, 28, 29, 100)], "document_id string, total_pages int")
        for n in (1, 2, 14, 15, 16, 27, 28, 29, 100):
            rows = sorted((r.first_page, r.last_page) for r in tree.reading_batches(pages.filter(F.col("total_pages") == n), size, overlap).collect())
            assert rows[0][0] == 0 and rows[-1][1] == n - 1
            assert all(b[0] == a[1] + 1 - overlap for a, b in zip(rows, rows[1:]))


def test_history_of_any_length(spark):
    for n in (0, 1, 6, 8, 9):
        rows = spark.createDataFrame([(1, i, " User", "x" * 300 if i % 2 else None) for i in range(n)], "conv_id long, turn int, role string, content string")
        found = sorted((r.turn, r.line) for r in chat.history_tail(rows).collect())
        assert [f[0] for f in found] == list(range(max(0, n - 6), n))
        assert all(line == "User: " + ("x" * 200 if turn % 2 else "") for turn, line in found)


def test_rerank_and_citations(spark):
    rows = spark.createDataFrame([(1, 1, 0, "d.pdf", None, "p.1", 0.9), (1, 1, 1, "", "Scope", None, 0.5), (1, 1, 2, "e.pdf", "Scope", "p.2", None)], "conv_id long, turn int, place int, document string, section string, pages string, score double")
    assert [(r.place, r.adjusted) for r in sorted(chat.rerank(rows).collect(), key=lambda r: r.rank_no)] == [(1, 0.5), (2, 0.3), (0, 0.27)]
    cited = [r[0] for r in rows.orderBy("place").select(chat.citation(F.col("document"), F.col("section"), F.col("pages"))).collect()]
    assert cited == ["[d.pdf → Unknown, p.1]", "[Scope, ?]", "[e.pdf → Scope, p.2]"]
