import random

from sparkgrove.llm import mixing as m

TARGETS = "mix_name string, source string, weight double, max_repeats int, size_ratio double"


def fill(weights, caps, total):
    """Plain water-filling in rounds."""
    got = {s: 0.0 for s in weights}
    free = {s for s in weights if weights[s] > 0 and caps[s] > 0}
    for s in weights:
        if weights[s] <= 0:
            got[s] = 0.0
    left = total
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if caps[s] < level * weights[s]}
        if not over:
            for s in free:
                got[s] = level * weights[s]
            return got
        for s in over:
            got[s] = caps[s]
            left -= caps[s]
        free -= over
    return got


def test_allotment_equals_plain_rounds(spark):
    rnd = random.Random(4)
    targets, sizes = [], {f"s{i}": rnd.choice([0, 10, 500, 5000]) for i in range(12)}
    for k in range(15):
        for s in rnd.sample(sorted(sizes), rnd.randint(1, 12)):
            targets.append((f"m{k}", s, rnd.choice([0.0, 0.1, 1.0, 7.0]), rnd.randint(1, 4), 0.2 + k / 5))
    total = sum(sizes.values())
    plan = m.allot(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(list(sizes.items()), "source string, tokens long"), total).collect()
    for k in range(15):
        own = {t[1]: t for t in targets if t[0] == f"m{k}"}
        want = fill({s: t[2] for s, t in own.items()}, {s: t[3] * sizes[s] for s, t in own.items()}, total * (0.2 + k / 5))
        for r in plan:
            if r.mix_name == f"m{k}":
                assert abs(r.allotted - want[r.source]) < 1e-6 * max(1, total)
                assert r.whole <= r.max_repeats and r.budget >= 0


def test_selection_keeps_caps_and_meets_budgets(spark):
    rnd = random.Random(6)
    docs = [(i, f"s{i % 3}" if i % 7 else "big", rnd.randint(0, 50)) for i in range(4000)] + [(-1, None, 9), (-2, "unlisted", 9)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int")
    sizes = frame.groupBy("source").sum("n_tokens").toDF("source", "tokens")
    targets = spark.createDataFrame([("m", "s0", 1.0, 1, 0.9), ("m", "s1", 2.0, 3, 0.9), ("m", "big", 8.0, 2, 0.9), ("m", "none", 1.0, 2, 0.9), ("n", "s0", 1.0, 9, 2.0), ("n", "s0", 1.0, 9, 2.0)], TARGETS)
    plan = m.allot(targets, sizes, sum(d[2] for d in docs))
    chosen = m.sample(frame, plan, seed=3)
    rows = chosen.collect()
    caps = {("m", "s0"): 1, ("m", "s1"): 3, ("m", "big"): 2, ("n", "s0"): 9}
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    assert all(1 <= r.repeats <= caps[r.mix_name, r.source] for r in rows)
    for r in m.shares(chosen, plan).collect():
        want = r.allotted_share
        assert abs(r.actual_share - want) < 0.0001, r
    assert sorted(map(tuple, rows)) == sorted(map(tuple, m.sample(frame, plan, seed=3).collect()))
    assert set(map(tuple, rows)) != set(map(tuple, m.sample(frame, plan, seed=4).collect()))


def test_nulls_and_empty_tables(spark):
    targets = spark.createDataFrame([("m", "a", None, None, None), (None, "a", 1.0, 1, 1.0), ("m", None, 1.0, 1, 1.0), ("k", "a", 1.0, None, 1.0), ("k", "b", 1.0, -2, 1.0)], TARGETS)
    sizes = spark.createDataFrame([("a", 10), ("b", 10)], "source string, tokens long")
    plan = {(r.mix_name, r.source): (r.allotted, r.whole) for r in m.allot(targets, sizes, 20).collect()}
    assert plan == {("m", "a"): (0.0, 0), ("k", "a"): (10.0, 1), ("k", "b"): (0.0, 0)}
    empty = m.allot(targets.limit(0), sizes, 20)
    docs = spark.createDataFrame([], "doc_id long, source string, n_tokens int, whole int")
    assert m.sample(docs, empty).count() == 0 and m.shares(m.sample(docs, empty), empty).count() == 0
