"""Queries of the library around the search: loading, folders, routing outcomes, contexts of answers, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.operators import catalog as c
from sparkgrove.operators import chat, search, tree
from sparkgrove.plans import search_queries as s
from sparkgrove.plans import tree_queries
from sparkgrove.session import materialize
from sparkgrove.sources import tables as t

#: Below this confidence a question is asked back; keywords that stand for a folder.
UNSURE, KEYWORDS = 0.5, 10


def _catalog(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return t.load_once(spark, sf_dir, "folder_docs", "batch_no", *columns).filter("batch_no = 0").drop("batch_no")


def find_doc_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document id in a folder the first entry that has it."""
    rows = _catalog(spark, sf_dir, "folder_name", "document_id", "ord", "filename").dropna(subset=["folder_name", "document_id"])
    first = rows.groupBy("folder_name", "document_id").agg(F.min(F.struct("ord", "entry_id", "filename")).alias("first"))
    return first.select("folder_name", "document_id", "first.entry_id", "first.filename")


def load_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each folder that messages name, whether it can be loaded; otherwise the error names those that can."""
    asked = t.load(spark, sf_dir, "chat_messages").select(F.col("folder_name").alias("name")).filter("name is not null").distinct()
    folders = t.load_once(spark, sf_dir, "folders").select("folder_name")
    listed = folders.agg(F.array_join(F.array_sort(F.collect_set("folder_name")), ", ").alias("listed"))  # a fixed table of few rows
    rows = asked.join(folders, asked["name"] == folders["folder_name"], "left").crossJoin(F.broadcast(listed))
    error = F.when(F.col("folder_name").isNull(), F.concat(F.lit("no folder '"), "name", F.lit("'; available: "), "listed"))
    return rows.select("name", error.alias("error"))


def load_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each accepted entry whether its index can be loaded: ok, no_index, or no_pdf, which is a warning."""
    rows = _catalog(spark, sf_dir, "document_id")
    indexed = t.load_once(spark, sf_dir, "doc_index", "pdf_path").select("document_id", F.col("pdf_path").alias("pdf"), F.lit(1).alias("indexed"))
    status = F.when(F.col("indexed").isNull(), "no_index").when(F.trim(F.coalesce("pdf", F.lit(""))) == "", "no_pdf").otherwise("ok")
    return rows.join(indexed, "document_id", "left").select("entry_id", status.alias("status"))


def load_index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of raw index files, missing fields by default; nulls for what can't be read. A record may lie under ``index``."""
    rows = t.load_once(spark, sf_dir, "index_records", "raw").select("record_id", F.try_parse_json("raw").alias("v"))

    def field(name: str, kind: str) -> Column:
        return F.coalesce(F.try_variant_get("v", f"$.{name}", kind), F.try_variant_get("v", f"$.index.{name}", kind))

    rows = rows.select("record_id", F.col("v").isNotNull().alias("readable"), field("filename", "string").alias("filename"), field("total_pages", "int").alias("total_pages"))
    return rows.select("record_id", "readable", F.when(F.col("readable"), F.coalesce("filename", F.lit(""))).alias("filename"), F.when(F.col("readable"), F.coalesce("total_pages", F.lit(0))).alias("total_pages"))


def folder_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One description per folder: how many documents it has, and their commonest keywords, at most ten.

    Keywords are counted before they are ranked, so that no folder's documents meet in one task.
    """
    rows = _catalog(spark, sf_dir, "folder_name", "keywords")
    counts = rows.select("folder_name", F.explode("keywords").alias("keyword")).filter("keyword is not null").groupBy("folder_name", "keyword").agg(F.count("*").alias("n"))
    top = counts.withColumn("place", F.row_number().over(W.partitionBy("folder_name").orderBy(F.desc("n"), "keyword"))).filter(F.col("place") <= KEYWORDS)
    words = top.groupBy("folder_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]), ", ").alias("keywords"))
    totals = rows.groupBy("folder_name").agg(F.count("*").alias("documents"))
    folders = t.load_once(spark, sf_dir, "folders").select("folder_name")
    found = folders.join(totals, "folder_name", "left").join(words, "folder_name", "left")
    text = F.when(F.col("documents").isNull(), F.concat(F.lit("Empty folder: "), "folder_name")).otherwise(F.concat(F.lit("Folder containing "), F.col("documents").cast("string"), F.lit(" documents")))
    return found.select("folder_name", text.alias("summary"), F.coalesce("keywords", F.lit("")).alias("keywords"))


def create_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What creating a folder by each name in messages and entries would give: exists, created, or why the name can't be."""
    names = t.load(spark, sf_dir, "chat_messages").select("folder_name").union(t.load(spark, sf_dir, "folder_docs").select("folder_name")).distinct()
    known = t.load_once(spark, sf_dir, "folders").select("folder_name", F.lit(1).alias("known"))
    verdict = c.check_name(F.col("folder_name"))
    rows = names.join(known, "folder_name", "left")
    return rows.select("folder_name", F.when(verdict != "ok", verdict).when(F.col("known") == 1, "exists").otherwise("created").alias("outcome"))


def drop_empty_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders that stay when those without accepted documents are deleted."""
    folders = t.load_once(spark, sf_dir, "folders", "folder_path")
    return folders.join(_catalog(spark, sf_dir, "folder_name").select("folder_name"), "folder_name", "left_semi")


def chat_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a chat goes on after each question: its folder with confidence, and asked back, empty_folder or answered.

    A question stays in its own folder if that exists; else it goes to the folder it names, or is asked back.
    """
    asked, folders = s.questions(spark, sf_dir), t.load_once(spark, sf_dir, "folders")
    known = folders.select("folder_name", F.col("folder_name").alias("own"))
    named = chat.named_folder(asked, folders).select("query_id", F.col("folder_name").alias("named"), "confidence")
    rows = asked.select("query_id", "folder_name").join(known, "folder_name", "left").join(named, "query_id")
    rows = rows.select("query_id", F.coalesce("own", "named").alias("folder_name"), F.when(F.col("own").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"))
    full = s.documents(spark, sf_dir).select("folder_name").distinct().withColumn("full", F.lit(1))
    outcome = F.when(F.col("confidence") < UNSURE, "asked_back").when(F.col("full").isNull(), "empty_folder").otherwise("answered")
    return rows.join(full, "folder_name", "left").select("query_id", "folder_name", "confidence", outcome.alias("outcome"))


def ask_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that an answer is written from: the (at most three) sections cited for each question, with their summary and relevance."""
    found = materialize(s.ask_routed(spark, sf_dir), "cited")
    rows = found.join(t.current_nodes(spark, sf_dir, "summary"), tree.NODE)
    inner, pages = F.regexp_extract("citation", r"(?s)^\[(.*), ([^,]*)\]$", 1), F.regexp_extract("citation", r"(?s)^\[(.*), ([^,]*)\]$", 2)
    relevance = F.format_string("%.2f", F.floor(F.col("mean") * 100 + 0.5) / 100)
    block = F.concat(F.lit("--- Source "), F.col("place").cast("string"), F.lit(": "), inner, F.lit(" ("), pages, F.lit(") ---\n"), F.coalesce("summary", F.lit("")), F.lit("\nRelevance: "), relevance)
    blocks = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("blocks"))
    return blocks.select("query_id", F.array_join(F.col("blocks.block"), "\n").alias("context"))


def topk_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three leaves per document that don't overlap, without the sections above them."""
    found = search.visited(s._searched(spark, sf_dir), "document_id").filter("leaf")
    return search.apart(found, "document_id").select("document_id", "rank_no", "node_id", "mean")


def revised_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the validation sample with their summary after it: one that says nothing is replaced by the title."""
    sample = tree_queries.validation_sample(spark, sf_dir)
    rows = sample.select(*tree.NODE).join(t.current_nodes(spark, sf_dir, "title", "summary"), tree.NODE)
    accurate = F.trim(F.coalesce("summary", F.lit(""))) != ""
    return rows.select(*tree.NODE, accurate.alias("is_accurate"), F.when(accurate, F.col("summary")).otherwise(F.col("title")).alias("summary"))


_CAT = "cat AS (SELECT DISTINCT ON (entry_id) * FROM folder_docs WHERE entry_id IS NOT NULL AND batch_no = 0)"
_LEAF = "od AS (SELECT *, row_number() OVER (PARTITION BY g, document_id ORDER BY rank_score DESC, a) AS i FROM rk"
_CUR = "(SELECT document_id, node_id, arg_max({'title': title, 'summary': summary}, loaded_at) AS v FROM (SELECT DISTINCT document_id, node_id, title, summary, loaded_at FROM tree_nodes WHERE document_id IS NOT NULL AND node_id IS NOT NULL) GROUP BY document_id, node_id)"

SQL = {
    "find_doc_by_id": f"WITH {_CAT} SELECT DISTINCT ON (folder_name, document_id) folder_name, document_id, entry_id, filename FROM cat WHERE folder_name IS NOT NULL AND document_id IS NOT NULL ORDER BY folder_name, document_id, ord NULLS FIRST, entry_id",
    "load_folder": """SELECT DISTINCT m.folder_name AS name, CASE WHEN f.folder_name IS NULL THEN 'no folder ''' || m.folder_name || '''; available: ' || (SELECT string_agg(x.folder_name, ', ' ORDER BY x.folder_name) FROM (SELECT DISTINCT folder_name FROM folders) x) END AS error
        FROM chat_messages m LEFT JOIN folders f ON f.folder_name = m.folder_name WHERE m.folder_name IS NOT NULL""",
    "load_index": f"""WITH {_CAT}, ix AS (SELECT DISTINCT ON (document_id) document_id, pdf_path FROM doc_index WHERE document_id IS NOT NULL)
        SELECT entry_id, CASE WHEN ix.document_id IS NULL THEN 'no_index' WHEN trim(coalesce(ix.pdf_path, '')) = '' THEN 'no_pdf' ELSE 'ok' END AS status FROM cat LEFT JOIN ix ON ix.document_id = cat.document_id""",
    "load_index_records": """WITH r AS (SELECT DISTINCT record_id, raw, coalesce(json_valid(raw), false) AS readable FROM index_records WHERE record_id IS NOT NULL),
        j AS (SELECT record_id, readable, CASE WHEN readable THEN json(raw) END AS v FROM r)
        SELECT record_id, readable, CASE WHEN readable THEN coalesce(v ->> '$.filename', v ->> '$.index.filename', '') END AS filename,
            CASE WHEN readable THEN coalesce(TRY_CAST(v ->> '$.total_pages' AS INTEGER), TRY_CAST(v ->> '$.index.total_pages' AS INTEGER), 0) END AS total_pages FROM j""",
    "folder_summaries": f"""WITH {_CAT}, kw AS (SELECT folder_name, keyword, count(*) AS n FROM (SELECT folder_name, unnest(keywords) AS keyword FROM cat) WHERE keyword IS NOT NULL GROUP BY ALL),
        tp AS (SELECT *, row_number() OVER (PARTITION BY folder_name ORDER BY n DESC, keyword) AS place FROM kw), wd AS (SELECT folder_name, string_agg(keyword, ', ' ORDER BY place) AS keywords FROM tp WHERE place <= 10 GROUP BY folder_name),
        tt AS (SELECT folder_name, count(*) AS documents FROM cat GROUP BY folder_name)
        SELECT f.folder_name, CASE WHEN documents IS NULL THEN 'Empty folder: ' || f.folder_name ELSE 'Folder containing ' || documents || ' documents' END AS summary, coalesce(keywords, '') AS keywords
        FROM (SELECT DISTINCT folder_name FROM folders) f LEFT JOIN tt USING (folder_name) LEFT JOIN wd USING (folder_name)""",
    "create_folders": """WITH n AS (SELECT folder_name FROM chat_messages UNION SELECT folder_name FROM folder_docs)
        SELECT folder_name, CASE WHEN trim(coalesce(folder_name, '')) = '' THEN 'blank' WHEN regexp_matches(folder_name, '[/\\\\:*?"<>|]') THEN 'bad_character' WHEN length(folder_name) > 200 THEN 'too_long'
            WHEN folder_name IN (SELECT folder_name FROM folders) THEN 'exists' ELSE 'created' END AS outcome FROM n""",
    "drop_empty_folders": f"WITH {_CAT} SELECT DISTINCT folder_name, folder_path FROM folders WHERE folder_name IN (SELECT folder_name FROM cat)",
    "chat_outcomes": f"""WITH {_CAT}, qs AS (SELECT DISTINCT message_id AS query_id, content, folder_name FROM chat_messages WHERE message_id % 100 = 0 AND lower(regexp_replace(role, '\\s', '', 'g')) = 'user' AND content IS NOT NULL),
        n AS (SELECT query_id, min(f.folder_name) AS named FROM qs JOIN folders f ON contains(lower(content), lower(f.folder_name)) GROUP BY query_id),
        r AS (SELECT query_id, f.folder_name AS own, coalesce(named, (SELECT min(folder_name) FROM folders)) AS named, CAST(CASE WHEN f.folder_name IS NOT NULL THEN 1.0 WHEN named IS NULL THEN 0.3 ELSE 0.7 END AS DOUBLE) AS confidence
              FROM qs LEFT JOIN n USING (query_id) LEFT JOIN (SELECT DISTINCT folder_name FROM folders) f ON f.folder_name = qs.folder_name)
        SELECT query_id, coalesce(own, named) AS folder_name, confidence, CASE WHEN confidence < 0.5 THEN 'asked_back' WHEN coalesce(own, named) NOT IN (SELECT folder_name FROM cat WHERE document_id IS NOT NULL AND folder_name IS NOT NULL) THEN 'empty_folder' ELSE 'answered' END AS outcome FROM r""",
    "ask_context": f"""SELECT query_id, string_agg('--- Source ' || place || ': ' || regexp_extract(citation, '(?s)^\\[(.*), ([^,]*)\\]$', 1) || ' (' || regexp_extract(citation, '(?s)^\\[(.*), ([^,]*)\\]$', 2) || ') ---' || chr(10) || coalesce(c.v.summary, '') || chr(10) || 'Relevance: ' || printf('%.2f', floor(mean * 100 + 0.5) / 100), chr(10) ORDER BY place) AS context
        FROM ({s.SQL['ask_routed']}) a JOIN {_CUR} c USING (document_id, node_id) GROUP BY query_id""",
    "topk_leaves": s.SQL["topk_nonoverlap"].replace(_LEAF, _LEAF + " WHERE NOT EXISTS (SELECT 1 FROM cur p WHERE p.document_id = rk.document_id AND p.parent_id = rk.node_id)"),
    "revised_summaries": f"""SELECT document_id, node_id, trim(coalesce(c.v.summary, '')) <> '' AS is_accurate, CASE WHEN trim(coalesce(c.v.summary, '')) <> '' THEN c.v.summary ELSE c.v.title END AS summary
        FROM ({tree_queries.SQL['validation_sample']}) x JOIN {_CUR} c USING (document_id, node_id)""",
}
QUERIES = {name: globals()[name] for name in SQL}
