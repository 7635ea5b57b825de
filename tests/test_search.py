"""Search of trees against a plain Python version, and properties of its results."""

import math
import random

from pyspark.sql import functions as F

from sparkgrove.functions import scoring
from sparkgrove.operators import search, tree


def random_tree(rnd, n, chain=False):
    parents = [None] + [i if chain else rnd.randint(0, i) for i in range(n - 1)]
    kids = {i: [j for j in range(n) if parents[j] == i] for i in range(n)}
    order = []

    def walk(i):
        order.append(i)
        for j in kids[i]:
            walk(j)

    walk(0)
    at = {i: k for k, i in enumerate(order)}
    return [(at[i], None if parents[i] is None else at[parents[i]]) for i in order]


def golden(nodes, scores):
    parent = dict(nodes)
    kids = {i: [j for j, p in nodes if p == i] for i, _ in nodes}
    n, w = [0] * len(nodes), [0.0] * len(nodes)
    steps = 0
    for _ in range(search.ITERATIONS):
        c, depth = 0, 0
        while kids[c] and depth < search.MAX_DEPTH and all(n[k] for k in kids[c]):
            bounds = [w[k] / n[k] + scoring.EXPLORATION * math.sqrt(math.log(n[c]) / n[k]) for k in kids[c]]
            c, depth = kids[c][bounds.index(max(bounds))], depth + 1
        target = next((k for k in kids[c] if not n[k]), c)
        up = target
        while up is not None:
            n[up], w[up], up = n[up] + 1, w[up] + scores[target], parent[up]
        steps += 1
        if sum(not kids[i] and n[i] >= search.SETTLED_VISITS and w[i] / n[i] >= search.SETTLED_MEAN for i in range(len(nodes))) >= search.TOP_K:
            break
    return n, steps


def searched(spark, trees):
    rows, words = [], []
    for d, (nodes, scores) in trees.items():
        for i, p in nodes:
            rows.append((d, f"{i:04d}", None if p is None else f"{p:04d}", i, [f"w{k}" for k in range(round(scores[i] * 10))], i, i))
    frame = spark.createDataFrame(rows, "document_id string, node_id string, parent_id string, preorder int, n_words array<string>, start_page int, end_page int")
    arrays = search.tree_arrays(frame, tree.closure(frame))
    query = F.array(*[F.lit(f"w{k}") for k in range(10)])
    assert not words
    return {r.document_id: (r.s.n, r.s.steps) for r in search.tree_search(arrays.withColumn("q_words", query)).collect()}


def test_fold_equals_plain_python(spark):
    rnd = random.Random(3)
    trees = {}
    for d in range(25):
        nodes = random_tree(rnd, rnd.randint(1, 30), chain=d == 24)
        trees[f"d{d}"] = (nodes, [rnd.randint(0, 10) / 10 for _ in nodes])
    trees["deep"] = (random_tree(rnd, 16, chain=True), [0.5] * 16)
    found = searched(spark, trees)
    assert found == {d: golden(*x) for d, x in trees.items()}
    for d, (n, steps) in found.items():
        assert n[0] == steps, "every simulation reaches the root"
        assert all(n[p] >= n[i] for i, p in trees[d][0] if p is not None)


def test_flat_search_visits_first_come_then_best(spark):
    row = spark.range(1).select(search.flat_visits(F.array(*map(F.lit, [0.1, 0.9, 0.1])), F.lit(15)).alias("v"), search.flat_visits(F.array().cast("array<double>"), F.lit(0)).alias("none")).first()
    assert sum(row.v) == 15 and row.v[1] == max(row.v) and row.none == []
    many = spark.range(1).select(search.flat_visits(F.array_repeat(F.lit(0.5), 20), F.lit(15)).alias("v")).first().v
    assert many == [1] * 15 + [0] * 5


def test_sections_apart_never_overlap(spark, data):
    from sparkgrove.plans import search_queries as q

    rows = search.apart(search.visited(q._searched(spark, data), "document_id"), "document_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.document_id, []).append((r.start_page, r.end_page))
    for pages in by.values():
        known = [p for p in pages if None not in p]
        assert len(pages) <= search.TOP_K
        assert all(not (a[0] <= b[1] and a[1] >= b[0]) for i, a in enumerate(known) for b in known[:i])


def test_bounds(spark):
    rows = spark.createDataFrame([(0, 0.0, 5), (5, 3.0, None), (4, 2.0, 9)], "n int, w double, p int")
    found = [r[0] for r in rows.select(scoring.ucb1(F.col("w"), F.col("n"), F.col("p"))).collect()]
    assert found[0] == float("inf") and abs(found[1] - 0.6) < 1e-12 and abs(found[2] - (0.5 + 1.414 * math.sqrt(math.log(9) / 4))) < 1e-12


def test_parsed_scores(spark):
    replies = [('{"relevance_score": 0.4}', 0.4), ('{"relevance_score": 7}', 1.0), ('{"relevance_score": -1}', 0.0), ("{}", 0.0), ("not json", 0.3), ('{"relevance_score": null}', 0.3), (None, 0.3)]
    rows = spark.createDataFrame(replies, "reply string, want double").select(scoring.parsed_score(F.col("reply")), "want")
    assert all(r[0] == r[1] for r in rows.collect())


def test_closure_of_long_chains_and_circles(spark):
    import pytest

    chain = spark.createDataFrame([("d", str(i), str(i - 1) if i else None) for i in range(40)], "document_id string, node_id string, parent_id string")
    assert tree.closure(chain).count() == 40 * 41 // 2
    circle = spark.createDataFrame([("d", "a", "b"), ("d", "b", "a")], "document_id string, node_id string, parent_id string")
    with pytest.raises(ValueError):
        tree.closure(circle, deepest=8)
