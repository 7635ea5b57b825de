"""Texts as pages (a line is a page), page ranges, sections found by their headings, and offline summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_no, page) with pages from 0; a null text has none, an empty one has one empty page."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("page_no", "page"))


def range_text(docs: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
    """The pages first .. last of each document as one text with page marks; documents without such pages are left out."""
    marked = F.transform(F.slice(F.split(text, "\n"), first + 1, last - first + 1), lambda p, i: F.concat(F.lit("--- Page "), (i + first + 1).cast("string"), F.lit(" ---\n"), p))
    return docs.filter(F.col(text).isNotNull()).select(key, F.array_join(marked, "\n\n").alias("pages_text")).filter("pages_text != ''")


def per_range(docs: DataFrame, ranges: DataFrame, key: str, text: str, value: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """(key, start_page, end_page, name) of each range of a document: ``value`` of the range's pages, an array, and its first page.

    The ranges of a document meet its text in one row, whose pages are split once; neither pages nor texts are shuffled by range.
    """
    spans = ranges.groupBy(key).agg(F.collect_list(F.struct("start_page", "end_page")).alias("_spans"))
    rows = docs.filter(F.col(text).isNotNull()).join(spans, key)

    def of_pages(pages: Column) -> Column:
        return F.transform("_spans", lambda r: F.struct(r["start_page"].alias("start_page"), r["end_page"].alias("end_page"), value(F.slice(pages, r["start_page"] + 1, r["end_page"] - r["start_page"] + 1), r["start_page"]).alias(name)))

    return rows.select(key, F.inline(F.transform(F.array(F.split(text, "\n")), of_pages)[0]))


def range_texts(docs: DataFrame, ranges: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_page, end_page, pages_text): the pages of each range of ``ranges`` as one text with page marks."""
    marked = lambda pages, first: F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("--- Page "), (i + first + 1).cast("string"), F.lit(" ---\n"), p)), "\n\n")
    return per_range(docs, ranges, key, text, marked, "pages_text")


def stub_sections(found: DataFrame, key: str) -> DataFrame:
    """(key, title, stub, start_page, end_page): found sections, but of a document without any heading one section 'Page N' per page.

    ``stub`` is the summary of such a section, null for found ones.
    """
    bare = F.max("ord").over(W.partitionBy(key)) == 0
    rows = found.withColumn("bare", bare).withColumn("first", F.explode(F.when(F.col("bare"), F.sequence("start_page", "end_page")).otherwise(F.array("start_page"))))
    number = (F.col("first") + 1).cast("string")
    title, stub = F.when(F.col("bare"), F.concat(F.lit("Page "), number)).otherwise(F.col("title")), F.when(F.col("bare"), F.concat(F.lit("Content on page "), number))
    return rows.select(key, title.alias("title"), stub.alias("stub"), F.col("first").alias("start_page"), F.when(F.col("bare"), F.col("first")).otherwise(F.col("end_page")).alias("end_page"))


def range_summaries(docs: DataFrame, ranges: DataFrame, key: str, text: str, pages: int = 5, chars: int = 200) -> DataFrame:
    """(key, start_page, end_page, summary): as ``summary``, of each range."""
    return per_range(docs, ranges, key, text, lambda ps, _: F.substring(F.array_join(F.slice(ps, 1, pages), " "), 1, chars), "summary")


def summary(docs: DataFrame, key: str, text: str, pages: int = 5, chars: int = 200) -> DataFrame:
    """Stand-in for a written summary: the beginning of the first pages, and how many of them there are."""
    head = F.slice(F.split(text, "\n"), 1, pages)
    return docs.filter(F.col(text).isNotNull()).select(key, F.substring(F.array_join(head, " "), 1, chars).alias("summary"), F.size(head).alias("pages_read"))


def sections(pages: DataFrame, key: str) -> DataFrame:
    """Sections by headings: a page of one to six words without a final stop opens a section that lasts to the next.

    Pages before the first heading form a section 'Document'. Result: key, ord, title, start_page, end_page.
    """
    words = F.size(F.filter(F.split(F.trim("page"), " +"), lambda w: w != ""))
    heading = (words >= 1) & (words <= 6) & ~F.col("page").rlike(r"[.!?:;,]\s*$")
    opened = F.sum(heading.cast("int")).over(W.partitionBy(key).orderBy("page_no"))
    rows = pages.withColumn("heading", heading).withColumn("ord", opened)
    title = F.coalesce(F.min(F.when(F.col("heading"), F.trim("page"))), F.lit("Document"))
    return rows.groupBy(key, "ord").agg(title.alias("title"), F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"))
