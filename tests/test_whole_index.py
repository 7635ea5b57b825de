"""Documents as sections and trees, with all of their pages."""

import pytest

from sparkgrove.plans import registry

TEXTS = [(1, "Scope\nThe pump was replaced in June.\nIt runs.\nIt was tested.\nCosts\nNine euros.\nNo more."), (2, "It has no heading.\nNone at all."), (3, ""), (4, None), (5, "Before any heading.\nScope\nText."), (1, "Scope\nThe pump was replaced in June.\nIt runs.\nIt was tested.\nCosts\nNine euros.\nNo more.")]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{place}/documents.parquet")
    return place


def test_texts_of_sections_hold_every_page_once(spark, texts):
    rows = sorted(registry.QUERIES["section_texts"](spark, texts).collect(), key=lambda r: (r.doc_id, r.start_page))
    assert [(r.doc_id, r.start_page, r.end_page) for r in rows] == [(1, 0, 3), (1, 4, 6), (2, 0, 1), (3, 0, 0), (5, 0, 0), (5, 1, 2)]
    assert rows[1].pages_text == "--- Page 5 ---\nCosts\n\n--- Page 6 ---\nNine euros.\n\n--- Page 7 ---\nNo more."
    for doc, text in TEXTS:
        found = "\n\n".join(r.pages_text for r in rows if r.doc_id == doc)
        assert found == "\n\n".join(f"--- Page {i + 1} ---\n{p}" for i, p in enumerate(text.split("\n"))) if text is not None else not found


def test_documents_become_trees(spark, texts):
    rows = sorted(registry.QUERIES["build_index"](spark, texts).collect(), key=lambda r: (r.document_id, r.preorder))
    trees = {}
    for r in rows:
        trees.setdefault(r.document_id, []).append((r.node_id, r.parent_id, r.level, r.title, r.start_page, r.end_page))
    assert trees[1] == [("0000", None, 0, "Document", 0, 6), ("0001", "0000", 1, "Scope", 0, 3), ("0002", "0000", 1, "Costs", 4, 6)]
    assert trees[2] == [("0000", None, 0, "Document", 0, 1), ("0001", "0000", 1, "Page 1", 0, 0), ("0002", "0000", 1, "Page 2", 1, 1)]
    assert [x[3:] for x in trees[3]] == [("Document", 0, 0), ("Page 1", 0, 0)] and 4 not in trees
    assert [x[3:] for x in trees[5][1:]] == [("Document", 0, 0), ("Scope", 1, 2)]
    assert [r.summary for r in rows if r.document_id in (1, 2)][1:] == ["Scope The pump was replaced in June. It runs. It was tested.", "Costs Nine euros. No more.", "Full document", "Content on page 1", "Content on page 2"]


def test_flat_trees_of_many_sections_and_of_none(spark):
    from sparkgrove.operators import tree

    sections = spark.range(10_001).selectExpr("'d' as document_id", "'s' as title", "'' as summary", "cast(id as int) as start_page", "cast(id as int) as end_page")
    totals = spark.createDataFrame([("d", 10_001), ("none", 4)], "document_id string, total_pages int")
    rows = tree.flat_tree(sections, totals).collect()
    assert len({(r.document_id, r.node_id) for r in rows}) == 10_003 and max(r.node_id for r in rows if r.preorder == 10_001) == "10001"
    assert [(r.node_id, r.end_page) for r in rows if r.document_id == "none"] == [("0000", 3)]
