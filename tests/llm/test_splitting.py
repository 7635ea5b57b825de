import random

from sparkgrove.llm import splitting as s


def greedy(first, last, starts, limit=15, overlap=2, least=3):
    pieces, at = [], first
    while last - at + 1 > limit:
        ends = [p - 1 for p in starts if at + least - 1 <= p - 1 <= at + limit - 1 and p <= last]
        end = max(ends, default=at + limit - 1)
        pieces.append((at, end))
        at = end + 1 - overlap
    return [*pieces, (at, last)]


def test_pieces_equal_the_stated_rule(spark):
    rnd = random.Random(8)
    items, starts = [], []
    for d in range(40):
        n = rnd.randint(16, 200)
        starts += [(f"d{d}", rnd.randint(0, n)) for _ in range(rnd.choice([0, 3, 30, 150]))]
        items += [(f"d{d}", a := rnd.randint(0, n - 16), rnd.randint(a + 15, n)) for _ in range(3)]
    found = s.cut_pages(spark.createDataFrame(items, "doc string, first int, last int"), spark.createDataFrame(starts, "doc string, page int"), "doc").collect()
    got = {}
    for r in sorted(found, key=lambda r: r.piece_no):
        got.setdefault((r.doc, r.first, r.last), []).append((r.first_page, r.last_page))
    assert got == {(d, a, b): greedy(a, b, {p for e, p in starts if e == d}) for d, a, b in items if b - a + 1 > 15}


def test_merging_by_strength():
    assert s.merge_segments([0, 2, 4, 6, 8], [3, 1, 2], 4) == [(0, 1), (2, 5), (6, 7)]
    assert s.merge_segments([0, 4, 8], [1], 4) == [(0, 3), (4, 7)]
    assert s.merge_segments([0, 3], [], 10) == [(0, 2)]
    for seed in range(200):
        rnd = random.Random(seed)
        bounds = sorted(rnd.sample(range(1, 120), rnd.randint(1, 30)))
        bounds = [0, *bounds, 120]
        pieces = s.merge_segments(bounds, [rnd.random() for _ in bounds[1:-1]], 20, 3)
        assert pieces[0][0] == 0 and pieces[-1][1] == 119
        assert all(b - a + 1 <= 20 for a, b in pieces)
        assert all(y[0] == max(x[1] + 1 - 3, 0) for x, y in zip(pieces, pieces[1:]))


def test_nulls_repeats_and_empty_tables(spark):
    items = spark.createDataFrame([("a", 0, 30, 9), ("a", 0, 30, 9), ("a", None, 30, 9), ("a", 3, None, 9), ("a", 5, 9, 9)], "doc string, first int, last int, starts int")
    none = spark.createDataFrame([], "doc string, page int")
    rows = s.cut_pages(items, none, "doc").collect()
    assert [(r.first_page, r.last_page) for r in sorted(rows, key=lambda r: r.piece_no)] == greedy(0, 30, set())
    assert s.cut_pages(items.limit(0), none, "doc").count() == 0
