"""Queries of the operators for language-model data (p1, p3, p4, p6, p7, p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.llm import history, mixing, pairs, spam, splitting, tokenizing
from sparkgrove.session import materialize
from sparkgrove.sources import tables as t

MAX_PAGES, OVERLAP, LEAST = 15, 2, 3


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective pairs of the chats, with the type of their defect."""
    return pairs.defects(t.load(spark, sf_dir, "chat_messages").select("conv_id", "turn", "role", "content"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page pieces of the nodes that span more than 15 pages."""
    nodes = t.current_nodes(spark, sf_dir, "start_page", "end_page").join(t.known_pages(spark, sf_dir), "document_id")
    first, last = t.clip_pages(F.col("start_page"), F.col("end_page"), F.col("total_pages"))
    nodes = materialize(nodes.select("document_id", "node_id", first.alias("first"), last.alias("last")).filter("first <= last"), "ranges")
    pieces = splitting.cut_pages(nodes, nodes.select("document_id", F.col("first").alias("page")), "document_id", MAX_PAGES, OVERLAP, LEAST)
    found = nodes.join(pieces, ["document_id", "first", "last"])
    return found.select("document_id", "node_id", "piece_no", "first_page", "last_page")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the new batches that repeat an accepted file, with the entry accepted for it."""
    return history.repeats(t.load(spark, sf_dir, "folder_docs").select("entry_id", "batch_no", "file_hash", "source_path", "filename"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokenizing.encode_column(t.load_once(spark, sf_dir, "documents", "text"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of tokens and whether its ids give the text back."""
    docs = t.load_once(spark, sf_dir, "documents", "text")
    ids = materialize(tokenizing.encode_column(docs, "doc_id", "text"), "ids")
    back = tokenizing.decode_column(ids, "doc_id").select("doc_id", F.md5("text").alias("back"))
    same = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5_text"))
    return ids.select("doc_id", F.size("ids").alias("n_tokens")).join(back, "doc_id").join(same, "doc_id").select("doc_id", "n_tokens", (F.col("back") == F.col("md5_text")).alias("same_text"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = t.load(spark, sf_dir, "documents").filter("doc_id is not null")
    counts = tokenizing.encode_column(docs.select(F.struct("doc_id", "source").alias("row"), "text"), "row", "text", count_only=True)
    # counted before repeated rows are dropped, so that no text is shuffled
    sized = materialize(counts.select("row.doc_id", "row.source", "n_tokens").dropDuplicates(["doc_id"]), "sizes")
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    plan = mixing.allot(t.load_once(spark, sf_dir, "mix_targets", "weight", "max_repeats", "size_ratio"), sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), total)
    return mixing.sample(sized, plan, seed=42), plan


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each occurs."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source the wanted, allotted and reached shares of tokens."""
    chosen, plan = _mix(spark, sf_dir)
    return mixing.shares(chosen, plan)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spam pages among the documents."""
    return spam.spam_pages(t.load(spark, sf_dir, "documents").select("doc_id", "text", "source")).filter("spam").select("doc_id")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}
