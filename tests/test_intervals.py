import random

from sparkgrove.operators.intervals import covered_and_gaps


def brute(intervals, spans):
    rows = set()
    for doc, low, high in spans:
        pages = [any(d == doc and s <= p <= e for d, s, e in intervals) for p in range(low, high + 1)]
        start = low
        for i in range(1, len(pages) + 1):
            if i == len(pages) or pages[i] != pages[i - 1]:
                rows.add((doc, "period" if pages[i - 1] else "gap", start, low + i - 1))
                start = low + i
    return rows


def run(spark, intervals, spans, block):
    a = spark.createDataFrame(intervals, "doc string, s int, e int")
    b = spark.createDataFrame(spans, "doc string, lo int, hi int")
    found = covered_and_gaps(a, b, ["doc"], "s", "e", "lo", "hi", block)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_intervals_equal_brute_force_at_any_block_size(spark):
    rnd = random.Random(5)
    spans = [(f"d{i}", 0, rnd.randint(0, 60)) for i in range(12)]
    intervals = [(f"d{rnd.randint(0, 11)}", s := rnd.randint(-5, 60), s + rnd.randint(0, 12)) for _ in range(60)]
    for block in (1, 4, 7, 4096):
        assert run(spark, intervals, spans, block) == brute(intervals, spans)


def test_edge_cases(spark):
    spans = [("none", 0, 4), ("full", 0, 4), ("one", 3, 3), ("bad", 5, 2), (None, 0, 3), ("nul", None, 3)]
    intervals = [("full", 0, 2), ("full", 3, 9), ("full", 3, 9), ("one", 3, 3), ("none", None, 2), ("none", 3, 1), ("other", 0, 9), ("bad", 0, 9)]
    assert run(spark, intervals, spans, 2) == {("none", "gap", 0, 4), ("full", "period", 0, 4), ("one", "period", 3, 3)}


def test_empty_tables_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc string, s int, e int")
    spans = spark.createDataFrame([("a", 0, 2, 7, 8)], "doc string, lo int, hi int, s int, kind int")
    assert [tuple(r) for r in covered_and_gaps(none, spans, ["doc"], "s", "e", "lo", "hi").collect()] == [("a", "gap", 0, 2)]
    assert covered_and_gaps(none, spans.limit(0), ["doc"], "s", "e", "lo", "hi").count() == 0


def test_one_entity_with_most_intervals(spark):
    rows = [("hot", i * 3, i * 3 + 1) for i in range(3000)] + [("cold", 0, 0)]
    found = run(spark, rows, [("hot", 0, 8999), ("cold", 0, 1)], 256)
    assert len(found) == 6002 and ("hot", "gap", 8999, 8999) in found
