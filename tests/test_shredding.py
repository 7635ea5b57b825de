import json

from hypothesis import given
from hypothesis import strategies as st

from sparkgrove.operators import shredding as s

SHAPE = s.Shape(("tree", "root"), ("index",), "children", frozenset({"node_id", "title", "keywords", "children"}))
NODE = {"node_id": "0000", "title": "a", "keywords": ["x", " y ", None, "  "], "children": []}


def found(spark, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "record_id long, raw string")
    elements = s.elements(rows, "record_id", "raw", SHAPE)
    return {(r.record_id, r.type, r.path, r.parent_path, r.value) for r in elements.collect() if r.type in ("node", "keywords")}


def test_shapes_of_children_and_keywords(spark):
    kid = {"node_id": "1", "title": "b"}
    raws = [
        json.dumps({"tree": NODE | {"children": [None, kid, {}, kid]}}),
        json.dumps({"root": NODE | {"children": {"k1": kid, "k0": kid}, "keywords": "p, q; r s;"}}),
        json.dumps([{"index": {"tree": NODE | {"children": kid, "keywords": [["a"], ["b", "c"]]}}, "format": 2}]),
        "﻿" + json.dumps(json.dumps({"tree": {"title": "no id", "keywords": [{"term": "t, u", "weight": 1}]}})),
    ]
    nodes = {(i, p, pp) for i, k, p, pp, _ in found(spark, raws) if k == "node"}
    assert nodes == {(0, "0", ""), (0, "0/0", "0"), (0, "0/1", "0"), (1, "0", ""), (1, "0/0", "0"), (1, "0/1", "0"), (2, "0", ""), (2, "0/0", "0"), (3, "0", "")}
    terms = {(i, p, v) for i, k, p, _, v in found(spark, raws) if k == "keywords"}
    assert terms == {(0, "0/k0", "x"), (0, "0/k1", "y"), (1, "0/k0", "p"), (1, "0/k1", "q"), (1, "0/k2", "r s"), (2, "0/k0", "a"), (2, "0/k1", "b"), (2, "0/k2", "c"), (3, "0/k0", "t, u")}


def test_unreadable_records_give_no_rows(spark):
    assert not found(spark, [None, "", "null", "{}", "[]", "5", '"x"', '{"tree": null}', '{"tree": {"node_id"', '{"other": {"node_id": "1"}}'])


def test_order_of_a_map_is_that_of_the_record(spark):
    raw = '{"tree": {"node_id": "r", "children": {"z": {"node_id": "first"}, "a": {"node_id": "second"}}}}'
    rows = s.elements(spark.createDataFrame([(1, raw)], "record_id long, raw string"), "record_id", "raw", SHAPE)
    assert {r.path: r.fields["node_id"] for r in rows.collect()} == {"0": "r", "0/0": "first", "0/1": "second"}


def test_deep_trees(spark):
    tree = {"node_id": "leaf"}
    for i in range(150):
        tree = {"node_id": str(i), "children": [tree]}
    assert len(found(spark, [json.dumps({"tree": tree})])) == 151


def test_tables_follow_the_schema_graph(spark):
    meta = {"meta": {"scorer": {"visits": 3}, "flags": ["f", "g"]}}
    raw = json.dumps({"tree": NODE | meta | {"children": [{"node_id": "1"} | meta]}})
    elements = s.elements(spark.createDataFrame([(7, raw)], "record_id long, raw string"), "record_id", "raw", SHAPE)
    tables = s.flat_tables(elements, "record_id")
    assert set(tables) == {"node", "keywords", "flags"}
    nodes = {r.path: r for r in tables["node"].collect()}
    assert nodes["0/0"].parent_path == "0" and nodes["0/0"].fields["meta.scorer.visits"] == "3"
    assert {r.parent_path for r in tables["keywords"].collect()} <= nodes.keys()
    assert {r.value for r in tables["flags"].collect()} == {"f", "g"}


def test_very_deep_records_are_read_whole(spark, tmp_path):
    from sparkgrove.plans.data_queries import p2_found

    deep = '{"node_id": "a", "keywords": ["k"], "children": [' * 10_000 + '{"node_id": "leaf"}' + "]}" * 10_000
    raws = ['{"tree": ' + deep + "}", json.dumps({"tree": NODE | {"children": [NODE]}}), '{"tree": ' + deep[:-1] + "}", '{"tree": {"node_id": "r", "other": ' + "[" * 5000 + "1" + "]" * 5000 + "}}"]
    spark.createDataFrame(list(enumerate(raws)), "record_id long, raw string").write.parquet(f"{tmp_path}/index_records.parquet")
    found = p2_found(spark, str(tmp_path)).groupBy("record_id", "kind").count().collect()
    assert {(r.record_id, r.kind): r["count"] for r in found} == {(0, "node"): 10_001, (0, "keyword"): 10_000, (1, "node"): 2, (1, "keyword"): 4, (3, "node"): 1}


def test_shape_comes_from_the_data(spark, tmp_path):
    from sparkgrove.plans.data_queries import p2_found

    def node(i, *parts):
        return {"node_id": str(i), "title": "t", "page": i, "keywords": ["k"], "parts": parts, "meta": {"scorer": {"visits": 1}}}

    raws = [json.dumps({"name": "a", "outline": node(0, node(1, node(2)), node(3))}), json.dumps({"box": {"outline": node(4, node(5, node(6)))}}), json.dumps(json.dumps({"body": node(7, node(8))})), "{", None, '{"outline": "none"}']
    rows = spark.createDataFrame(list(enumerate(raws)), "record_id long, raw string")
    shape = s.shape_of(s.field_graph(rows, "raw"))
    assert (shape.roots, shape.wrappers, shape.children) == (("outline", "body"), ("box",), "parts")
    rows.write.parquet(f"{tmp_path}/index_records.parquet")
    found = {(r.record_id, r.item_path, r.parent_path, r.item_value) for r in p2_found(spark, str(tmp_path)).filter("kind = 'node'").collect()}
    assert found == {(0, "0", "", "0"), (0, "0/0", "0", "1"), (0, "0/0/0", "0/0", "2"), (0, "0/1", "0", "3"), (1, "0", "", "4"), (1, "0/0", "0", "5"), (1, "0/0/0", "0/0", "6"), (2, "0", "", "7"), (2, "0/0", "0", "8")}
    assert s.shape_of(s.field_graph(rows.limit(0), "raw")) is None


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


@given(JSON, st.sampled_from([None, 1]), st.text("[]{},:\"1ab \\", max_size=12))
def test_parsing_with_a_stack_equals_the_library(value, indent, other):
    assert s._parse_deep(json.dumps(value, indent=indent)) == value
    for text in (other, json.dumps(value)[:-1]):
        try:
            want = json.loads(text)
        except ValueError:
            want = ValueError
        try:
            got = s._parse_deep(text)
        except ValueError:
            got = ValueError
        assert got == want


def test_own_tables():
    edges = [("document", "node", False), ("node", "node", True), ("node", "meta", False), ("meta", "scorer", False), ("node", "keywords", True), ("scorer", "note", False), ("meta", "note", False)]
    home = s.own_tables(edges)
    assert home == {"node": "node", "meta": "node", "scorer": "node", "keywords": "keywords", "note": "note"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "record_id long, raw string, path string")
    assert s.flat_tables(s.elements(none, "record_id", "raw", SHAPE), "record_id") == {}


def test_node_ids_among_more_fields_than_columns(spark, tmp_path):
    from sparkgrove.plans.data_queries import p2_found

    raw = json.dumps({"tree": {f"a{i:03d}": str(i) for i in range(250)} | {"node_id": "0042", "children": [{"title": "none", "a000": "1", "a001": "2"}]}})
    spark.createDataFrame([(1, raw)], "record_id long, raw string").write.parquet(f"{tmp_path}/index_records.parquet")
    assert {(r.item_path, r.item_value) for r in p2_found(spark, str(tmp_path)).collect()} == {("0", "0042"), ("0/0", "0000")}
    spark.createDataFrame([(1, None)], "record_id long, raw string").write.parquet(f"{tmp_path}/none/index_records.parquet")
    assert p2_found(spark, f"{tmp_path}/none").count() == 0
