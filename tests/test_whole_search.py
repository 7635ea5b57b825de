"""Search over all documents of a folder, on tables made for it."""

import datetime

import pytest

from sparkgrove.plans import registry

PUMP = "why did the pump seal fail"


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    """Twenty documents in folder alpha, of which only the 18th answers, and one in folder beta."""
    place = str(tmp_path_factory.mktemp("shelf"))
    day = datetime.datetime(2024, 1, 1)
    docs = [(0, "alpha", f"a{i}.pdf", i, i, f"d{i:02d}", PUMP if i == 18 else "budget", ["k"]) for i in range(1, 21)] + [(0, "beta", "b.pdf", 30, 1, "d30", "valve", ["k"])]
    asked = [(100, 1, 1, "user", PUMP, "alpha"), (200, 2, 1, "user", "what does beta say on the valve", None), (300, 3, 1, "user", PUMP, "gone")]
    nodes = [(d[5], "0000", None, 0, 0, 0, "Scope", d[6], ["k"], 0, 3, day) for d in docs]
    tables = {
        "folder_docs": (docs, "batch_no int, folder_name string, filename string, entry_id long, ord int, document_id string, summary string, keywords array<string>"),
        "chat_messages": (asked, "message_id long, conv_id long, turn int, role string, content string, folder_name string"),
        "tree_nodes": (nodes, "document_id string, node_id string, parent_id string, ord int, preorder int, level int, title string, summary string, keywords array<string>, start_page int, end_page int, loaded_at timestamp"),
        "folders": ([("alpha",), ("beta",)], "folder_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{place}/{name}.parquet")
    return place


def test_documents_after_the_fifteenth_are_searched(spark, shelf):
    assert "d18" in {r.document_id for r in registry.QUERIES["phase2_search_full"](spark, shelf).collect()}
    best = next(r for r in registry.flagship(spark, shelf).collect() if r.query_id == 100 and r.place == 1)
    assert (best.document_id, best.citation) == ("d18", "[a18.pdf → Scope, pp.1-4]")


def test_questions_without_a_folder_are_routed(spark, shelf):
    best = {r.query_id: r.document_id for r in registry.flagship(spark, shelf).collect() if r.place == 1}
    assert best == {100: "d18", 200: "d30", 300: "d18"}
