"""Queries of document trees and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.operators import intervals, tree
from sparkgrove.sources import tables as t


def _nodes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return t.current_nodes(spark, sf_dir, *columns)


def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.leaves(_nodes(spark, sf_dir, "parent_id")).select(*tree.NODE)


def find_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root that each index names, looked up among the current nodes."""
    wanted = t.load_once(spark, sf_dir, "doc_index", "root_id").select("document_id", F.col("root_id").alias("node_id"))
    return wanted.join(_nodes(spark, sf_dir, "title", "start_page", "end_page"), tree.NODE, "left").select(*tree.NODE, "title", "start_page", "end_page")


def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, leaves and depth of each tree."""
    nodes = _nodes(spark, sf_dir, "parent_id", "level")
    inner = nodes.filter("parent_id is not null").select("document_id", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(1))
    joined = nodes.join(inner, tree.NODE, "left")
    return joined.groupBy("document_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("inner").isNull()).alias("leaves"), F.max("level").alias("depth"))


def page_range_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir, "start_page", "end_page").dropna(subset=["start_page", "end_page"])
    return nodes.select(*tree.NODE, tree.page_range(F.col("start_page"), F.col("end_page")).alias("page_range"))


def tree_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One indented line per node."""
    nodes = _nodes(spark, sf_dir, "preorder", "level", "title", "summary", "start_page", "end_page")
    pages = F.coalesce(tree.page_range(F.col("start_page"), F.col("end_page")), F.lit("?"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("["), "node_id", F.lit("] "), F.coalesce("title", F.lit("Unknown")), F.lit(" ("), pages, F.lit(") "), F.substring(F.coalesce("summary", F.lit("")), 1, 80))
    return nodes.select(*tree.NODE, "preorder", line.alias("line"))


def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.closure(_nodes(spark, sf_dir, "parent_id"))


def build_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.by_level(_nodes(spark, sf_dir, "preorder", "level"))


def section_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.first_sections(_nodes(spark, sf_dir, "preorder", "title", "start_page"))


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's pages that its sections cover; what lies outside the document counts too."""
    ranges = _nodes(spark, sf_dir, "level", "start_page", "end_page").filter("level >= 1")
    return tree.coverage(ranges, t.known_pages(spark, sf_dir))


def uncovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pages to be read again, of documents whose sections cover less than 70 percent of their pages."""
    ranges = _nodes(spark, sf_dir, "level", "start_page", "end_page").filter("level >= 1")
    pages = t.known_pages(spark, sf_dir)
    low = tree.coverage(ranges, pages).filter("ratio < 0.7").select("document_id", F.lit(0).alias("low"), (F.col("total_pages") - 1).alias("high"))
    runs = intervals.covered_and_gaps(ranges, low, ["document_id"], "start_page", "end_page", "low", "high")
    return runs.filter("kind = 'gap'").select("document_id", F.col("first").alias("first_page"), F.col("last").alias("last_page"))


def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.reading_batches(t.known_pages(spark, sf_dir))


def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten nodes of each tree, in preorder, that are leaves or span more than three pages, and the pages to check."""
    nodes = _nodes(spark, sf_dir, "parent_id", "preorder", "start_page", "end_page")
    inner = nodes.filter("parent_id is not null").select("document_id", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(1))
    chosen = nodes.join(inner, tree.NODE, "left").filter("inner is null or end_page - start_page >= 3")
    ranked = chosen.withColumn("rank_no", F.row_number().over(W.partitionBy("document_id").orderBy("preorder"))).filter("rank_no <= 10")
    return ranked.select(*tree.NODE, "rank_no", "start_page", F.least(F.col("end_page"), F.col("start_page") + 4).alias("last_checked"))


def tree_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nested_json(_nodes(spark, sf_dir, "parent_id", "ord", "title", "summary", "start_page", "end_page", "level"))


_NODES = """
    WITH RECURSIVE cur AS (SELECT document_id, node_id, v.* FROM (SELECT document_id, node_id, arg_max({'parent_id': parent_id, 'ord': ord, 'preorder': preorder, 'level': level, 'title': title,
        'summary': summary, 'start_page': start_page, 'end_page': end_page}, loaded_at) AS v FROM (SELECT DISTINCT * FROM tree_nodes WHERE document_id IS NOT NULL AND node_id IS NOT NULL) GROUP BY document_id, node_id))"""
_PAGES = "CASE WHEN start_page = end_page THEN 'p.' || (start_page + 1) ELSE 'pp.' || (start_page + 1) || '-' || (end_page + 1) END"
_DOCS = "docs AS (SELECT document_id, max(total_pages) AS n FROM doc_index WHERE total_pages > 0 GROUP BY document_id)"
_COVER = f"""{_NODES}, {_DOCS}, pg AS (SELECT DISTINCT document_id, unnest(range(start_page, end_page + 1)) AS page FROM cur WHERE level >= 1 AND start_page <= end_page),
    cov AS (SELECT d.document_id, d.n AS total_pages, count(pg.page) AS covered, floor(count(pg.page) / d.n * 1e6 + 0.5) / 1e6 AS ratio FROM docs d LEFT JOIN pg USING (document_id) GROUP BY d.document_id, d.n)"""


def _nested_sql(deepest: int = 20) -> str:
    """Levels unrolled from the deepest that the given trees can have."""
    own = "to_json({'node_id': node_id, 'title': title, 'summary': summary, 'start_page': start_page, 'end_page': end_page, 'level': level})"
    text = f"substr({own}::VARCHAR, 1, length({own}::VARCHAR) - 1) || ',\"children\":['"
    parts = [f"{_NODES}, l{deepest} AS (SELECT document_id, parent_id, ord, node_id, {text} || ']}}' AS j FROM cur WHERE level = {deepest})"]
    for k in range(deepest - 1, -1, -1):
        parts.append(f"l{k} AS (SELECT c.document_id, c.parent_id, c.ord, c.node_id, {text.replace('node_id,', 'c.node_id,')} || coalesce(k.js, '') || ']}}' AS j FROM cur c LEFT JOIN "
                     f"(SELECT document_id AS d, parent_id AS p, string_agg(j, ',' ORDER BY ord, node_id) AS js FROM l{k + 1} GROUP BY ALL) k ON k.d = c.document_id AND k.p = c.node_id WHERE c.level = {k})")  # fmt: skip
    return ", ".join(parts) + " SELECT document_id, j AS tree FROM l0 WHERE parent_id IS NULL"


SQL = {
    "leaf_nodes": f"{_NODES} SELECT document_id, node_id FROM cur c WHERE NOT EXISTS (SELECT 1 FROM cur k WHERE k.document_id = c.document_id AND k.parent_id = c.node_id)",
    "find_node": f"{_NODES} SELECT i.document_id, i.root_id AS node_id, title, start_page, end_page FROM (SELECT DISTINCT document_id, root_id FROM doc_index) i LEFT JOIN cur ON cur.document_id = i.document_id AND cur.node_id = i.root_id",
    "tree_stats": f"""{_NODES}, inn AS (SELECT DISTINCT document_id, parent_id FROM cur WHERE parent_id IS NOT NULL)
        SELECT c.document_id, count(*) AS nodes, count(*) FILTER (inn.parent_id IS NULL) AS leaves, max(level) AS depth FROM cur c LEFT JOIN inn ON inn.document_id = c.document_id AND inn.parent_id = c.node_id GROUP BY c.document_id""",
    "page_range_fmt": f"{_NODES} SELECT document_id, node_id, {_PAGES} AS page_range FROM cur WHERE start_page IS NOT NULL AND end_page IS NOT NULL",
    "tree_outline": f"""{_NODES} SELECT document_id, node_id, preorder, repeat('  ', level) || '[' || node_id || '] ' || coalesce(title, 'Unknown') || ' (' || coalesce({_PAGES}, '?') || ') ' || substr(coalesce(summary, ''), 1, 80) AS line FROM cur""",
    "tree_closure": f"""{_NODES}, cl AS (SELECT document_id, node_id AS ancestor_id, node_id, 0 AS distance, parent_id FROM cur
        UNION ALL SELECT cl.document_id, c.node_id, cl.node_id, cl.distance + 1, c.parent_id FROM cl JOIN cur c ON c.document_id = cl.document_id AND c.node_id = cl.parent_id)
        SELECT document_id, ancestor_id, node_id, distance FROM cl""",
    "build_tree": f"""{_NODES} SELECT c.document_id, c.node_id, arg_max(p.node_id, p.preorder) AS parent_id FROM cur c LEFT JOIN cur p ON p.document_id = c.document_id AND p.preorder < c.preorder AND p.level < c.level GROUP BY ALL""",
    "section_dedup": f"{_NODES} SELECT document_id, title, start_page, arg_min(node_id, preorder) AS node_id, count(*) AS copies FROM cur GROUP BY document_id, title, start_page",
    "page_coverage": f"{_COVER} SELECT * FROM cov",
    "uncovered_runs": f"""{_COVER}, un AS (SELECT document_id, page, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS g FROM (SELECT document_id, unnest(range(0, total_pages)) AS page FROM cov WHERE ratio < 0.7) a
        WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.document_id = a.document_id AND pg.page = a.page))
        SELECT document_id, min(page) AS first_page, max(page) AS last_page FROM un GROUP BY document_id, g""",
    "page_batches": f"""WITH {_DOCS}, b AS (SELECT document_id, n, unnest(range(0, n, 13)) AS s FROM docs)
        SELECT document_id, CAST(s // 13 + 1 AS INTEGER) AS batch_no, CAST(s AS INTEGER) AS first_page, CAST(least(s + 14, n - 1) AS INTEGER) AS last_page FROM b WHERE s = 0 OR s + 2 < n""",
    "validation_sample": f"""{_NODES}, inn AS (SELECT DISTINCT document_id, parent_id FROM cur WHERE parent_id IS NOT NULL),
        r AS (SELECT c.*, row_number() OVER (PARTITION BY c.document_id ORDER BY preorder) AS rank_no FROM cur c LEFT JOIN inn ON inn.document_id = c.document_id AND inn.parent_id = c.node_id WHERE inn.parent_id IS NULL OR end_page - start_page >= 3)
        SELECT document_id, node_id, CAST(rank_no AS INTEGER) AS rank_no, start_page, CASE WHEN end_page IS NULL THEN start_page + 4 WHEN start_page IS NULL THEN end_page ELSE least(end_page, start_page + 4) END AS last_checked FROM r WHERE rank_no <= 10""",
    "tree_to_json": _nested_sql(),
}
QUERIES = {name: globals()[name] for name in SQL}
