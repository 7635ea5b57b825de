"""Queries of the catalog: listing, checks, upserts, health and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.operators import catalog as c
from sparkgrove.sources import tables as t

NOW = "2024-01-10 00:00:00"


def _entries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return t.load_once(spark, sf_dir, "folder_docs", *columns)


def _catalog(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The accepted history."""
    return _entries(spark, sf_dir, "batch_no", *columns).filter("batch_no = 0").drop("batch_no")


def _new(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _entries(spark, sf_dir, "batch_no", *columns).filter("batch_no > 0")


def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.same_content(t.load_once(spark, sf_dir, "documents", "text"), "doc_id", "text")


def list_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that have an index, by name."""
    folders = t.load_once(spark, sf_dir, "folders").select("folder_name")
    return folders.join(t.load(spark, sf_dir, "folder_docs").filter("batch_no = 0").select("folder_name"), "folder_name", "left_semi").orderBy("folder_name")


def folder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalog(spark, sf_dir, "folder_name", "total_pages")
    return rows.groupBy("folder_name").agg(F.count("*").alias("total_documents"), F.sum(F.coalesce("total_pages", F.lit(0))).alias("total_pages"))


def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folders with their totals and when they were last changed."""
    folders = t.load_once(spark, sf_dir, "folders", "folder_path", "created_at", "updated_at")
    rows = folders.join(folder_totals(spark, sf_dir), "folder_name", "left").fillna(0, ["total_documents", "total_pages"])
    return rows.select("folder_name", "folder_path", "total_documents", "total_pages", "created_at", c.time_ago(F.col("updated_at"), NOW).alias("updated"))


def folder_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that describe a folder to the router, one row each, in the order of entry_id."""
    rows = _catalog(spark, sf_dir, "folder_name", "filename", "total_pages", "summary")
    line = F.concat(F.lit("- "), "filename", F.lit(" ("), F.coalesce(F.col("total_pages").cast("string"), F.lit("?")), F.lit(" pages): "), F.coalesce("summary", F.lit("")))
    return rows.filter("filename is not null").select("folder_name", "entry_id", line.alias("line"))


def validate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir, "source_path", "filename", "file_hash", "total_pages")
    verdict = c.check_file(F.col("source_path"), F.col("filename"), F.col("file_hash"), F.col("total_pages"))
    return rows.select("entry_id", verdict.alias("verdict"), F.coalesce(F.col("total_pages") > c.LARGE, F.lit(False)).alias("is_large"))


def validate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that messages or entries give a folder or a file, with what is wrong with it."""
    messages = t.load(spark, sf_dir, "chat_messages").select(F.col("folder_name").alias("name"))
    files = t.load(spark, sf_dir, "folder_docs").select(F.explode(F.array("folder_name", "filename")).alias("name"))
    return messages.unionByName(files).distinct().select("name", c.check_name(F.col("name")).alias("verdict"))


def find_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the history that each new entry meets under its name in its folder."""
    new = _new(spark, sf_dir, *c.ENTRY_KEY).select("entry_id", *c.ENTRY_KEY)
    found = c.first_entry(new, _catalog(spark, sf_dir, *c.ENTRY_KEY, "ord"), c.ENTRY_KEY, {"entry_id": "found_entry_id"})
    return found.select("entry_id", "found_entry_id")


def needs_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalog(spark, sf_dir, "document_id", "file_hash")
    made = t.load_once(spark, sf_dir, "doc_index", "file_hash").groupBy("document_id").agg(F.min(c.clean_hash(F.col("file_hash"))).alias("indexed_hash"))
    joined = rows.join(made, "document_id", "left")
    return joined.select("entry_id", (~F.col("indexed_hash").eqNullSafe(c.clean_hash(F.col("file_hash"))) | F.col("indexed_hash").isNull()).alias("needs_reindex"))


def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.upsert(_entries(spark, sf_dir, *c.ENTRY_KEY).dropna(subset=c.ENTRY_KEY))


def catalog_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the history when the names of the new batches are removed."""
    return c.remove(_catalog(spark, sf_dir, *c.ENTRY_KEY), _new(spark, sf_dir, *c.ENTRY_KEY)).select("entry_id", *c.ENTRY_KEY)


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.ingest_actions(_new(spark, sf_dir, *c.ENTRY_KEY, "file_hash"), _catalog(spark, sf_dir, *c.ENTRY_KEY, "file_hash"))


def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each batch that pass and fail the checks, and whether the batch fails as a whole."""
    rows = _new(spark, sf_dir, "source_path", "filename", "file_hash", "total_pages")
    ok = c.check_file(F.col("source_path"), F.col("filename"), F.col("file_hash"), F.col("total_pages")) == "ok"
    counts = rows.groupBy("batch_no").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    return counts.select("batch_no", "succeeded", "failed", (F.col("succeeded") == 0).alias("raises"))


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (*c.ENTRY_KEY, "file_hash", "pdf_path")
    return c.health(_catalog(spark, sf_dir, "document_id", *columns), t.load_once(spark, sf_dir, "doc_index", *columns))


def folder_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).groupBy("folder_name", "status").agg(F.count("*").alias("documents"))


def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.repair(_statuses(spark, sf_dir))


def resolve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.resolve(t.load_once(spark, sf_dir, "doc_index", *c.ENTRY_KEY), _catalog(spark, sf_dir, *c.ENTRY_KEY, "document_id", "pdf_path", "ord"))


def time_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, "indexed_at").select("entry_id", c.time_ago(F.col("indexed_at"), NOW).alias("ago"))


_CTE = """
    WITH fd AS (SELECT DISTINCT * FROM folder_docs WHERE entry_id IS NOT NULL), cat AS (SELECT * FROM fd WHERE batch_no = 0), nw AS (SELECT * FROM fd WHERE batch_no > 0),
    di AS (SELECT DISTINCT * FROM doc_index WHERE document_id IS NOT NULL)"""
_HASH = "nullif(regexp_extract(lower(file_hash), '([0-9a-f]{32})', 1), '')"
_CHECK = f"""CASE WHEN coalesce(trim(source_path), '') = '' THEN 'not_found' WHEN NOT lower(coalesce(filename, '')) LIKE '%.pdf' THEN 'not_pdf'
    WHEN coalesce({_HASH}, '') = '{c.EMPTY_FILE}' THEN 'empty_file' WHEN total_pages IS NULL THEN 'corrupt' WHEN total_pages < 1 THEN 'no_pages'
    WHEN total_pages > {c.TOO_LARGE} THEN 'too_large' ELSE 'ok' END"""


def _ago(column: str) -> str:
    gap = f"(epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch({column}))::BIGINT)"
    return f"""CASE WHEN {column} IS NULL THEN 'unknown' WHEN {gap} < 60 THEN 'just now' WHEN {gap} < 3600 THEN (floor({gap} / 60)::BIGINT)::VARCHAR || 'm ago'
    WHEN {gap} < 86400 THEN (floor({gap} / 3600)::BIGINT)::VARCHAR || 'h ago' ELSE (floor({gap} / 86400)::BIGINT)::VARCHAR || 'd ago' END"""


_HEALTH = f"""{_CTE}, made AS (SELECT document_id, min({_HASH}) AS ih FROM di GROUP BY document_id),
    st AS (SELECT folder_name, filename, c.document_id, CASE WHEN pdf_path IS NULL THEN 'missing_pdf' WHEN m.document_id IS NULL THEN 'missing_index'
        WHEN ({_HASH}) IS DISTINCT FROM ih THEN 'stale' ELSE 'healthy' END AS status FROM cat c LEFT JOIN made m USING (document_id)
      UNION ALL SELECT folder_name, filename, document_id, 'orphan' FROM di WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.document_id = di.document_id))"""

SQL = {
    "doc_identity": """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5(text) AS file_hash, substr(md5(text), 1, 12) AS document_id, count(*) OVER (PARTITION BY md5(text)) AS copies FROM d""",
    "list_folders": "SELECT DISTINCT folder_name FROM folders WHERE folder_name IN (SELECT folder_name FROM folder_docs WHERE batch_no = 0)",
    "folder_totals": f"{_CTE} SELECT folder_name, count(*) AS total_documents, CAST(sum(coalesce(total_pages, 0)) AS BIGINT) AS total_pages FROM cat GROUP BY folder_name",
    "folder_listing": f"""{_CTE}, tot AS (SELECT folder_name, count(*) AS n, CAST(sum(coalesce(total_pages, 0)) AS BIGINT) AS p FROM cat GROUP BY folder_name)
        SELECT f.folder_name, folder_path, coalesce(n, 0) AS total_documents, coalesce(p, 0) AS total_pages, created_at, {_ago('updated_at')} AS updated
        FROM (SELECT DISTINCT * FROM folders) f LEFT JOIN tot USING (folder_name)""",
    "folder_descriptions": f"""{_CTE} SELECT folder_name, entry_id, '- ' || filename || ' (' || coalesce(total_pages::VARCHAR, '?') || ' pages): ' || coalesce(summary, '') AS line
        FROM cat WHERE filename IS NOT NULL""",
    "validate_docs": f"{_CTE} SELECT entry_id, {_CHECK} AS verdict, coalesce(total_pages > {c.LARGE}, false) AS is_large FROM fd",
    "validate_names": r"""WITH n AS (SELECT folder_name AS name FROM chat_messages UNION SELECT folder_name FROM folder_docs UNION SELECT filename FROM folder_docs)
        SELECT name, CASE WHEN trim(coalesce(name, '')) = '' THEN 'blank' WHEN regexp_matches(name, '[/\\:*?"<>|]') THEN 'bad_character' WHEN length(name) > 200 THEN 'too_long' ELSE 'ok' END AS verdict FROM n""",
    "find_doc": f"""{_CTE}, f AS (SELECT folder_name, filename, arg_min(entry_id, {{'o': ord, 'e': entry_id}}) AS e FROM cat GROUP BY ALL)
        SELECT nw.entry_id, f.e AS found_entry_id FROM nw LEFT JOIN f USING (folder_name, filename)""",
    "needs_reindex": f"""{_CTE}, made AS (SELECT document_id, min({_HASH}) AS ih FROM di GROUP BY document_id)
        SELECT entry_id, (ih IS NULL OR ih IS DISTINCT FROM ({_HASH})) AS needs_reindex FROM cat LEFT JOIN made USING (document_id)""",
    "catalog_upsert": f"{_CTE} SELECT folder_name, filename, max(entry_id) AS entry_id, count(*) AS versions FROM fd WHERE folder_name IS NOT NULL AND filename IS NOT NULL GROUP BY ALL",
    "catalog_remove": f"{_CTE} SELECT entry_id, folder_name, filename FROM cat WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.folder_name = cat.folder_name AND nw.filename = cat.filename)",
    "incremental_ingest": f"""{_CTE}, k AS (SELECT folder_name, filename, list({_HASH}) FILTER (({_HASH}) IS NOT NULL) AS hs FROM cat GROUP BY ALL)
        SELECT entry_id, nw.folder_name, nw.filename, CASE WHEN k.folder_name IS NULL THEN 'add' WHEN coalesce(list_contains(hs, {_HASH}), false) THEN 'skip' ELSE 'replace' END AS action
        FROM nw LEFT JOIN k USING (folder_name, filename)""",
    "batch_outcome": f"""{_CTE}, v AS (SELECT batch_no, ({_CHECK}) = 'ok' AS ok FROM nw)
        SELECT batch_no, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok) = 0 AS raises FROM v GROUP BY batch_no""",
    "folder_health": f"{_HEALTH} SELECT folder_name, status, count(*) AS documents FROM st GROUP BY ALL",
    "repair_plan": f"""{_HEALTH} SELECT folder_name, filename, document_id, status,
        CASE status WHEN 'missing_pdf' THEN 'warn' WHEN 'orphan' THEN 'delete_index' ELSE 'reindex' END AS action FROM st WHERE status <> 'healthy'""",
    "resolve_source": f"""{_CTE}, u AS (SELECT * FROM cat WHERE pdf_path IS NOT NULL), bi AS (SELECT document_id, arg_min(pdf_path, {{'o': ord, 'e': entry_id}}) AS p FROM u WHERE document_id IS NOT NULL GROUP BY ALL),
        bn AS (SELECT folder_name, filename, arg_min(pdf_path, {{'o': ord, 'e': entry_id}}) AS p FROM u GROUP BY ALL)
        SELECT di.document_id, coalesce(bi.p, bn.p) AS file_path, CASE WHEN bi.p IS NOT NULL THEN 'id' WHEN bn.p IS NOT NULL THEN 'filename' END AS found_by
        FROM di LEFT JOIN bi USING (document_id) LEFT JOIN bn ON bn.folder_name = di.folder_name AND bn.filename = di.filename""",
    "time_ago": f"{_CTE} SELECT entry_id, {_ago('indexed_at')} AS ago FROM fd",
}
QUERIES = {name: globals()[name] for name in SQL}
