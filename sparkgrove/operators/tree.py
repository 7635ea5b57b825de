"""Document trees as tables: adjacency rows, ancestor pairs, page coverage, outlines and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.operators import intervals
from sparkgrove.session import materialize

NODE = ["document_id", "node_id"]


def page_range(start: Column, end: Column) -> Column:
    """Pages for display, counted from one: p.N or pp.A-B; null where a bound is unknown."""
    one, more = F.concat(F.lit("p."), (start + 1).cast("string")), F.concat(F.lit("pp."), (start + 1).cast("string"), F.lit("-"), (end + 1).cast("string"))
    return F.when(start == end, one).otherwise(more)


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = nodes.filter("parent_id is not null").select("document_id", F.col("parent_id").alias("node_id"))
    return nodes.join(parents, NODE, "left_anti")


def closure(nodes: DataFrame, deepest: int = 1024) -> DataFrame:
    """(document_id, ancestor_id, node_id, distance) of every node with itself and all its ancestors.

    Distances double with each join, so a tree of depth d takes log2(d) joins. A node whose parent is missing ends its
    chain there; chains longer than ``deepest`` (or circles) raise an error.
    """
    own = nodes.select("document_id", F.col("node_id").alias("ancestor_id"), "node_id", F.lit(0).alias("distance"))
    present = nodes.select("document_id", F.col("node_id").alias("ancestor_id"))
    step = nodes.filter("parent_id is not null").select("document_id", F.col("parent_id").alias("ancestor_id"), "node_id", F.lit(1).alias("distance")).join(present, ["document_id", "ancestor_id"], "left_semi")
    pairs, reach = materialize(step, "closure"), 1
    farthest = pairs
    while not farthest.isEmpty():
        if reach > deepest:
            raise ValueError(f"a chain of parents is longer than {deepest}")
        up = pairs.select("document_id", F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("far_id"), F.col("distance").alias("more"))
        longer = farthest.join(up, ["document_id", "ancestor_id"]).select("document_id", F.col("far_id").alias("ancestor_id"), "node_id", (F.col("distance") + F.col("more")).alias("distance"))
        longer = materialize(longer, "closure")
        pairs, reach = pairs.unionByName(longer), reach * 2
        farthest = longer.filter(F.col("distance") == reach)
    return own.unionByName(pairs)


def by_level(nodes: DataFrame) -> DataFrame:
    """(document_id, node_id, parent_id) rebuilt from preorder and level alone: the last node before with a lower level.

    The nodes of one document are folded in one row, as a document is read by one reader; the fold keeps the nodes that are still
    open, one per level, so the plan is the same however deep the trees are. A node without a level has no parent and is none.
    """
    kind = "struct<level: int, node_id: string>"
    listed = F.array_sort(F.collect_list(F.struct("preorder", "node_id", F.col("level").cast("int").alias("level"))))
    rows = nodes.groupBy("document_id").agg(listed.alias("nodes"))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("open"), F.array().cast("array<struct<node_id: string, parent_id: string>>").alias("done"))

    def step(state: Column, node: Column) -> Column:
        above = F.filter(state["open"], lambda x: x["level"] < node["level"])
        own = F.array(F.struct(node["level"].alias("level"), node["node_id"].alias("node_id")))
        parent = F.try_element_at(above, F.lit(-1))["node_id"]
        done = F.concat(state["done"], F.array(F.struct(node["node_id"].alias("node_id"), parent.alias("parent_id"))))
        return F.struct(F.when(node["level"].isNull(), state["open"]).otherwise(F.concat(above, own)).alias("open"), done.alias("done"))

    return rows.select("document_id", F.inline(F.aggregate("nodes", start, step, lambda s: s["done"])))


def first_sections(nodes: DataFrame) -> DataFrame:
    """Of sections with the same title and first page in a document, the first in preorder."""
    first = nodes.groupBy("document_id", "title", "start_page").agg(F.min(F.struct("preorder", "node_id")).alias("_first"), F.count("*").alias("copies"))
    return first.select("document_id", "title", "start_page", F.col("_first.node_id").alias("node_id"), "copies")


def flat_tree(sections: DataFrame, totals: DataFrame) -> DataFrame:
    """The nodes of flat trees: of every document of ``totals`` a root over all of its pages, and its sections in page order as the root's children.

    Sections are (document_id, title, summary, start_page, end_page), totals (document_id, total_pages). A document without sections is a root
    alone. Ids have four digits, more where a document has more sections.
    """
    order = W.partitionBy("document_id").orderBy("start_page", "title")
    kids = sections.withColumn("preorder", F.row_number().over(order))
    kids = kids.select("document_id", F.format_string("%04d", "preorder").alias("node_id"), F.lit("0000").alias("parent_id"), "preorder", F.lit(1).alias("level"), "title", "summary", "start_page", "end_page")
    roots = totals.select("document_id", F.lit("0000").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("preorder"), F.lit(0).alias("level"), F.lit("Document").alias("title"), F.lit("Full document").alias("summary"), F.lit(0).alias("start_page"), (F.col("total_pages") - 1).alias("end_page"))
    return roots.unionByName(kids)


def coverage(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, total_pages, covered (distinct pages in the ranges, outside the document too) and their ratio.

    Covered periods are swept and their lengths summed up, so that a range costs the same however many pages it names.
    """
    known = ranges.filter("start_page <= end_page").select("document_id", "start_page", "end_page")
    spans = known.groupBy("document_id").agg(F.min("start_page").alias("low"), F.max("end_page").alias("high"))
    periods = intervals.covered_and_gaps(known, spans, ["document_id"], "start_page", "end_page", "low", "high").filter("kind = 'period'")
    counts = periods.groupBy("document_id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("covered"))
    rows = pages.join(counts, "document_id", "left").fillna(0, ["covered"])
    return rows.select("document_id", "total_pages", "covered", (F.floor(F.col("covered") / F.col("total_pages") * 1e6 + 0.5) / 1e6).alias("ratio"))


def reading_batches(pages: DataFrame, size: int = 15, overlap: int = 2) -> DataFrame:
    """(document_id, batch_no, first_page, last_page): pages in batches that overlap, until the last page is read."""
    if not 0 <= overlap < size:
        raise ValueError("needs 0 <= overlap < size")
    stride = size - overlap
    last_start = F.greatest(F.floor((F.col("total_pages") - overlap - 1) / stride) * stride, F.lit(0)).cast("int")
    rows = pages.filter("total_pages > 0").select("document_id", "total_pages", F.posexplode(F.sequence(F.lit(0), last_start, F.lit(stride))).alias("batch", "first_page"))
    return rows.select("document_id", (F.col("batch") + 1).alias("batch_no"), "first_page", F.least(F.col("first_page") + size - 1, F.col("total_pages") - 1).alias("last_page"))


def nested_json(nodes: DataFrame) -> DataFrame:
    """(document_id, tree) with each document's nodes nested as JSON, from the deepest level up.

    One aggregation per level joins finished children to their parents; only the levels, not the nodes, are known to the driver.
    """
    deepest = nodes.agg(F.max("level")).first()[0]
    columns = ["title", "summary", "start_page", "end_page", "level"]
    below = None
    for level in range(deepest if deepest is not None else 0, -1, -1):
        rows = nodes.filter(F.col("level") == level)
        if below is None:
            rows = rows.withColumn("children", F.lit(""))
        else:
            kids = below.groupBy("document_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", "json"))), lambda x: x["json"]), ",").alias("children"))
            rows = rows.join(kids, NODE, "left").fillna("", ["children"])
        own = F.to_json(F.struct("node_id", *columns), {"ignoreNullFields": "false"})
        below = rows.select("document_id", "parent_id", "ord", "node_id", F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['), "children", F.lit("]}")).alias("json"))
    return below.filter("parent_id is null").select("document_id", F.col("json").alias("tree"))
