"""Queries of chats, routing and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.functions import scoring
from sparkgrove.operators import chat, pages, tree
from sparkgrove.plans.search_queries import questions
from sparkgrove.session import materialize
from sparkgrove.sources import tables as t


def _messages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return t.load_once(spark, sf_dir, "chat_messages", *columns)


def chat_history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.history_tail(_messages(spark, sf_dir, "role", "content"))


def source_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.cards(_messages(spark, sf_dir, "sources"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.cards(_messages(spark, sf_dir, "sources"))
    return rows.select("conv_id", "turn", "place", chat.citation(F.col("document"), F.col("section"), F.col("pages")).alias("citation"))


def deep_read_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rerank(chat.cards(_messages(spark, sf_dir, "sources")))


def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.contexts(_messages(spark, sf_dir, "sources"))


def relevance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by band of their score, five bands of 0.2."""
    band = F.least(F.floor(F.col("score") * 5) + 1, F.lit(5)).cast("int")
    rows = chat.cards(_messages(spark, sf_dir, "sources"))
    return rows.filter("score is not null").groupBy(band.alias("band")).agg(F.count("*").alias("sources"))


def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read back from judgements as a model would return them: some null, some out of range, some not readable."""
    rows = chat.cards(_messages(spark, sf_dir, "sources"))
    kind = F.col("conv_id") % 4
    value = F.coalesce(F.col("score").cast("string"), F.lit("null"))
    reply = F.when(kind == 0, F.concat(F.lit('{"relevance_score": '), value, F.lit("}"))).when(kind == 1, F.concat(F.lit('{"relevance_score": 1'), F.lit("7}"))).when(kind == 2, F.lit('{"reasoning": "none"}')).otherwise(F.lit('{"relevance_score": '))
    return rows.select("conv_id", "turn", "place", scoring.parsed_score(reply).alias("parsed"))


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.usage(_messages(spark, sf_dir, "folder_name", "role", "content", "stats"))


def route_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.named_folder(questions(spark, sf_dir), t.load_once(spark, sf_dir, "folders"))


def route_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose folder exists."""
    return _messages(spark, sf_dir, "folder_name").join(t.load_once(spark, sf_dir, "folders").select("folder_name"), "folder_name", "left_semi").select("conv_id", "turn", "folder_name")


def skip_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index files that can be read as JSON, by folder, and those skipped."""
    rows = t.load_once(spark, sf_dir, "index_records", "folder_name", "raw")
    readable = F.coalesce(F.try_parse_json("raw").isNotNull(), F.lit(False))
    return rows.groupBy("folder_name").agg(F.count_if(readable).alias("readable"), F.count_if(~readable).alias("skipped"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_pages(t.load_once(spark, sf_dir, "documents", "text"), "doc_id", "text")


def doc_head_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pages(spark, sf_dir).filter("page_no < 5").select("doc_id", "page_no", F.length("page").alias("chars"))


def page_text_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample: the pages 1 to 3 of every text; section_texts has all pages."""
    return pages.range_text(t.load_once(spark, sf_dir, "documents", "text"), "doc_id", "text", 1, 3)


def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.summary(t.load_once(spark, sf_dir, "documents", "text"), "doc_id", "text")


def build_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.sections(doc_pages(spark, sf_dir), "doc_id")


def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every section, with page marks."""
    return pages.range_texts(t.load_once(spark, sf_dir, "documents", "text"), build_sections(spark, sf_dir), "doc_id", "text")


def build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tree of every text, as nodes: sections, stubs where there are none, repeated sections dropped, a root.

    The sections found by headings leave no page uncovered, so there are no runs to be read again. Null texts have no pages and no tree.
    """
    docs = t.load_once(spark, sf_dir, "documents", "text").filter("text is not null")
    found = materialize(pages.stub_sections(build_sections(spark, sf_dir), "doc_id"), "sections")
    placed = found.select(F.col("doc_id").alias("document_id"), F.col("start_page").alias("node_id"), F.col("start_page").alias("preorder"), "title", "stub", "start_page", "end_page")
    kept = placed.join(tree.first_sections(placed).select(*tree.NODE), tree.NODE, "left_semi")
    texts = pages.range_summaries(docs, found.filter("stub is null"), "doc_id", "text").withColumnsRenamed({"doc_id": "document_id", "summary": "text"})
    rows = kept.join(texts, ["document_id", "start_page", "end_page"], "left").withColumn("summary", F.coalesce("stub", "text"))
    return tree.flat_tree(rows.select("document_id", "title", "summary", "start_page", "end_page"), found.groupBy(F.col("doc_id").alias("document_id")).agg((F.max("end_page") + 1).alias("total_pages")))


_CM = "WITH cm AS (SELECT DISTINCT ON (conv_id, turn) * FROM chat_messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"
_CARDS = f"""{_CM}, sx AS (SELECT conv_id, turn, sources, unnest(range(0, len(sources))) AS place FROM cm),
    ca AS (SELECT conv_id, turn, CAST(place AS INTEGER) AS place, sources[place + 1].document AS document, sources[place + 1].section AS section, sources[place + 1].pages AS pages, round(sources[place + 1].score, 3) AS score FROM sx)"""
_ROLE = r"lower(regexp_replace(role, '\s', '', 'g'))"
_DOC = "WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)"
_PG = f"{_DOC}, px AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM d WHERE text IS NOT NULL), pg AS (SELECT doc_id, CAST(i AS INTEGER) AS page_no, ps[i + 1] AS page FROM (SELECT *, unnest(range(0, len(ps))) AS i FROM px))"
_WORDS = "CASE WHEN trim(coalesce(content, ''), ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(content, ' '), ' +')) END"

SQL = {
    "chat_history_tail": f"""{_CM}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM cm)
        SELECT conv_id, turn, CAST(back AS INTEGER) AS back, upper(substr({_ROLE}, 1, 1)) || substr({_ROLE}, 2) || ': ' || substr(coalesce(content, ''), 1, 200) AS line FROM b WHERE back <= 6""",
    "source_cards": f"{_CARDS} SELECT * FROM ca",
    "citations": f"""{_CARDS} SELECT conv_id, turn, place, CASE WHEN coalesce(document, '') = '' THEN '[' ELSE '[' || document || ' → ' END || coalesce(section, 'Unknown') || ', ' || coalesce(pages, '?') || ']' AS citation FROM ca""",
    "deep_read_rerank": f"""{_CARDS}, ad AS (SELECT conv_id, turn, place, round(coalesce(score, 0.3) * CASE WHEN section IS NULL THEN 0.3 ELSE 1.0 END, 6) AS adjusted FROM ca)
        SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY adjusted DESC, place) AS INTEGER) AS rank_no FROM ad""",
    "answer_context": f"""{_CARDS} SELECT conv_id, turn, string_agg('--- Source ' || (place + 1) || ': ' || coalesce(document, '?') || ' → ' || coalesce(section, '?') || ' (' || coalesce(pages, '?') || ') ---', chr(10) ORDER BY place) AS context FROM ca GROUP BY conv_id, turn""",
    "relevance_bands": f"{_CARDS} SELECT CAST(least(floor(score * 5) + 1, 5) AS INTEGER) AS band, count(*) AS sources FROM ca WHERE score IS NOT NULL GROUP BY 1",
    "score_parse": f"""{_CARDS} SELECT conv_id, turn, place, CASE conv_id % 4 WHEN 0 THEN CASE WHEN score IS NULL THEN 0.3 ELSE greatest(least(score, 1.0), 0.0) END WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.0 ELSE 0.3 END AS parsed FROM ca""",
    "usage_cost": f"""{_CM}, u AS (SELECT folder_name, count(*) FILTER (cardinality(stats) > 0) AS answers, CAST(sum(TRY_CAST(TRY_CAST(replace(stats['llm_calls'], '$', '') AS DOUBLE) AS BIGINT)) AS BIGINT) AS calls,
            round(sum(TRY_CAST(replace(stats['cost'], '$', '') AS DOUBLE)), 4) AS reported_cost, CAST(sum(CASE WHEN {_ROLE} = 'user' THEN {_WORDS} ELSE 0 END) AS BIGINT) AS input_words,
            CAST(sum(CASE WHEN {_ROLE} = 'assistant' THEN {_WORDS} ELSE 0 END) AS BIGINT) AS output_words FROM cm GROUP BY folder_name)
        SELECT *, round(input_words / 1e6 * 2.5 + output_words / 1e6 * 10.0, 4) AS list_cost FROM u""",
    "route_fallback": f"""WITH qs AS (SELECT DISTINCT message_id AS query_id, content FROM chat_messages WHERE message_id % 100 = 0 AND {_ROLE} = 'user' AND content IS NOT NULL),
        n AS (SELECT query_id, min(f.folder_name) AS named FROM qs JOIN folders f ON contains(lower(content), lower(f.folder_name)) GROUP BY query_id)
        SELECT query_id, coalesce(named, (SELECT min(folder_name) FROM folders)) AS folder_name, CAST(CASE WHEN named IS NULL THEN 0.3 ELSE 0.7 END AS DOUBLE) AS confidence FROM qs LEFT JOIN n USING (query_id)""",
    "route_validate": f"{_CM} SELECT conv_id, turn, folder_name FROM cm WHERE folder_name IN (SELECT folder_name FROM folders)",
    "skip_corrupt": """WITH r AS (SELECT DISTINCT record_id, folder_name, raw FROM index_records)
        SELECT folder_name, count(*) FILTER (coalesce(json_valid(raw), false)) AS readable, count(*) FILTER (NOT coalesce(json_valid(raw), false)) AS skipped FROM r GROUP BY folder_name""",
    "doc_pages": f"{_PG} SELECT * FROM pg",
    "doc_head_pages": f"{_PG} SELECT doc_id, page_no, length(page) AS chars FROM pg WHERE page_no < 5",
    "page_text_range": f"{_PG} SELECT doc_id, string_agg('--- Page ' || (page_no + 1) || ' ---' || chr(10) || page, chr(10) || chr(10) ORDER BY page_no) AS pages_text FROM pg WHERE page_no BETWEEN 1 AND 3 GROUP BY doc_id",
    "doc_summary": f"{_PG} SELECT doc_id, substr(array_to_string(ps[1:5], ' '), 1, 200) AS summary, least(len(ps), 5) AS pages_read FROM px",
    "build_sections": f"""{_PG}, hd AS (SELECT *, len(list_filter(regexp_split_to_array(trim(page, ' '), ' +'), lambda w: w <> '')) BETWEEN 1 AND 6 AND NOT regexp_matches(page, '[.!?:;,]\\s*$') AS heading FROM pg),
        so AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY page_no) AS ord FROM hd)
        SELECT doc_id, CAST(ord AS BIGINT) AS ord, coalesce(min(CASE WHEN heading THEN trim(page, ' ') END), 'Document') AS title, min(page_no) AS start_page, max(page_no) AS end_page FROM so GROUP BY doc_id, ord""",
}
SQL["section_texts"] = f"""{_PG}, se AS ({SQL['build_sections']}) SELECT se.doc_id, start_page, end_page, string_agg('--- Page ' || (page_no + 1) || ' ---' || chr(10) || page, chr(10) || chr(10) ORDER BY page_no) AS pages_text
    FROM se JOIN pg ON pg.doc_id = se.doc_id AND page_no BETWEEN start_page AND end_page GROUP BY se.doc_id, start_page, end_page"""
SQL["build_index"] = f"""{_PG}, se AS ({SQL['build_sections']}), ob AS (SELECT *, max(ord) OVER (PARTITION BY doc_id) = 0 AS bare FROM se),
    ss AS (SELECT doc_id, title, substr(array_to_string(ps[start_page + 1:least(end_page + 1, start_page + 5)], ' '), 1, 200) AS summary, start_page, end_page FROM ob JOIN px USING (doc_id) WHERE NOT bare
        UNION ALL SELECT doc_id, 'Page ' || (page_no + 1), 'Content on page ' || (page_no + 1), page_no, page_no FROM pg WHERE doc_id IN (SELECT doc_id FROM ob WHERE bare)),
    nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_page, title) AS INTEGER) AS preorder FROM ss)
    SELECT doc_id AS document_id, printf('%04d', preorder) AS node_id, '0000' AS parent_id, preorder, 1 AS level, title, summary, start_page, end_page FROM nu
    UNION ALL SELECT doc_id, '0000', NULL, 0, 0, 'Document', 'Full document', 0, CAST(len(ps) - 1 AS INTEGER) FROM px"""
QUERIES = {name: globals()[name] for name in SQL}
