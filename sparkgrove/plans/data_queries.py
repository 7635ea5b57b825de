"""Queries of the general data operators: nested records (p2) and page intervals (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.operators import intervals, shredding
from sparkgrove.session import materialize
from sparkgrove.sources import tables as t


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.load(spark, sf_dir, "index_records").select("record_id", "raw")
    shape = shredding.shape_of(shredding.field_graph(raw, "raw"))
    if shape is None:
        return spark.createDataFrame([], f"record_id long, {shredding.ELEMENTS}")
    return materialize(shredding.elements(t.load_once(spark, sf_dir, "index_records", "raw"), "record_id", "raw", shape), "elements")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and keywords of the raw index files, each with the path of its parent."""
    tables = shredding.flat_tables(_elements(spark, sf_dir), "record_id")
    empty = spark.createDataFrame([], "record_id long, path string, parent_path string, value string, fields map<string, string>")
    nodes, terms = (tables.get(k, empty) for k in ("node", "keywords"))
    # of more fields than a table has columns some stay in the map
    node_id = F.col("node_id") if "node_id" in nodes.columns else F.col("fields")["node_id"]
    columns = ["record_id", "kind", "item_path", "parent_path", "item_value"]
    nodes = nodes.select("record_id", F.lit("node"), "path", "parent_path", F.coalesce(node_id, F.lit("0000"))).toDF(*columns)
    terms = terms.select("record_id", F.lit("keyword"), "path", "parent_path", "value").toDF(*columns)
    return nodes.unionByName(terms)


def p2_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema graph of the index files, and which table each element type goes to."""
    found = _elements(spark, sf_dir)
    graph = shredding.schema_graph(found)
    home = shredding.own_tables([tuple(r) for r in graph.select("parent_type", "type", "repeated").collect()])
    homes = spark.createDataFrame(list(home.items()), "type string, table_name string")
    return graph.join(F.broadcast(homes), "type", "left").select("parent_type", "type", "occurrences", "repeated", F.array_join("field_names", ",").alias("field_names"), "table_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered periods and gaps of each document's pages by its sections below the root."""
    pages = t.known_pages(spark, sf_dir)
    nodes = t.current_nodes(spark, sf_dir, "level", "start_page", "end_page").filter("level >= 1 and start_page is not null and end_page is not null")
    ranges = nodes.select("document_id", F.least("start_page", "end_page").alias("s"), F.greatest("start_page", "end_page").alias("e"))
    spans = pages.select("document_id", F.lit(0).alias("low"), (F.col("total_pages") - 1).alias("high"))
    runs = intervals.covered_and_gaps(ranges, spans, ["document_id"], "s", "e", "low", "high")
    return runs.select("document_id", "kind", F.col("first").cast("int").alias("first_page"), F.col("last").cast("int").alias("last_page"))


#: Current rows of tree_nodes and the documents with known pages, for the SQL of several queries.
CURRENT = """
    cur AS (SELECT document_id, node_id, arg_max({'level': level, 's': start_page, 'e': end_page}, loaded_at) AS v
            FROM (SELECT DISTINCT document_id, node_id, level, start_page, end_page, loaded_at FROM tree_nodes) GROUP BY ALL),
    docs AS (SELECT document_id, max(total_pages) AS n FROM doc_index WHERE total_pages > 0 GROUP BY document_id),
    rng AS (SELECT c.document_id, c.node_id, c.v.level AS level, greatest(least(c.v.s, c.v.e), 0) AS s, least(greatest(c.v.s, c.v.e), d.n - 1) AS e, d.n
            FROM cur c JOIN docs d USING (document_id) WHERE c.v.s IS NOT NULL AND c.v.e IS NOT NULL)"""

SQL = {
    "p5_found": f"""
    WITH {CURRENT},
    pages AS (SELECT document_id, unnest(range(0, n)) AS page FROM docs),
    cov AS (SELECT DISTINCT document_id, unnest(range(s, e + 1)) AS page FROM rng WHERE level >= 1 AND s <= e),
    st AS (SELECT p.document_id, p.page, CASE WHEN c.page IS NULL THEN 'gap' ELSE 'period' END AS kind FROM pages p LEFT JOIN cov c USING (document_id, page)),
    isl AS (SELECT *, page - row_number() OVER (PARTITION BY document_id, kind ORDER BY page) AS g FROM st)
    SELECT document_id, kind, CAST(min(page) AS INTEGER) AS first_page, CAST(max(page) AS INTEGER) AS last_page FROM isl GROUP BY document_id, kind, g""",
}
QUERIES = {"p2_found": p2_found, "p2_schema": p2_schema, "p5_found": p5_found}
