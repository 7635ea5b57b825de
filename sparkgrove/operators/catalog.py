"""The catalog of folders and their documents: identity, checks, upserts, health and repair.

All functions take and give DataFrames with the columns of folder_docs or doc_index. Order within a folder
is that of ``entry_id``, the order of delivery; no function needs a window over a whole folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_KEY = ["folder_name", "filename"]
#: Pages above which a document is called large, and above which it is refused.
LARGE, TOO_LARGE = 1000, 5000
#: Hash of a file without content.
EMPTY_FILE = "d41d8cd98f00b204e9800998ecf8427e"


def short_id(file_hash: Column) -> Column:
    """A document's id: the first 12 characters of its hash."""
    return F.substring(file_hash, 1, 12)


def clean_hash(file_hash: Column) -> Column:
    """The 32 hexadecimal digits of a hash in lower case; null where there are none."""
    digits = F.regexp_extract(F.lower(file_hash), "([0-9a-f]{32})", 1)
    return F.when(digits != "", digits)


def same_content(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, file_hash (md5), document_id and the number of rows with the same content; null texts have no identity."""
    hashed = texts.filter(F.col(text).isNotNull()).select(key, F.md5(text).alias("file_hash"))
    counts = hashed.groupBy("file_hash").agg(F.count("*").alias("copies"))
    return hashed.join(counts, "file_hash").select(key, "file_hash", short_id(F.col("file_hash")).alias("document_id"), "copies")


def check_file(path: Column, filename: Column, file_hash: Column, pages: Column) -> Column:
    """The first check that a file fails, in the order in which files are opened; 'ok' if none.

    A file without path can't be found, the suffix has to be .pdf in any case, a file with the hash of nothing is empty,
    one whose pages are unknown couldn't be opened.
    """
    return (
        F.when(F.coalesce(F.trim(path), F.lit("")) == "", "not_found")
        .when(~F.lower(F.coalesce(filename, F.lit(""))).endswith(".pdf"), "not_pdf")
        .when(F.coalesce(clean_hash(file_hash), F.lit("")) == EMPTY_FILE, "empty_file")
        .when(pages.isNull(), "corrupt")
        .when(pages < 1, "no_pages")
        .when(pages > TOO_LARGE, "too_large")
        .otherwise("ok")
    )


def check_name(name: Column) -> Column:
    """Whether a folder may be called so: 'blank', 'bad_character', 'too_long' or 'ok'."""
    text = F.coalesce(name, F.lit(""))
    return F.when(F.trim(text) == "", "blank").when(text.rlike(r'[/\\:*?"<>|]'), "bad_character").when(F.length(text) > 200, "too_long").otherwise("ok")


def upsert(entries: DataFrame) -> DataFrame:
    """The catalog after all deliveries: of each (folder, filename) the last entry, which moves to the end of its folder.

    Adds ``versions``, how often the name was delivered. Order within the folder is that of entry_id.
    """
    last = entries.groupBy(*ENTRY_KEY).agg(F.max("entry_id").alias("entry_id"), F.count("*").alias("versions"))
    return last.select(*ENTRY_KEY, "entry_id", "versions")


def remove(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """The entries of the catalog whose (folder, filename) isn't among ``names``."""
    return catalog.join(names.select(*ENTRY_KEY).distinct(), ENTRY_KEY, "left_anti")


def ingest_actions(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """What adding each new entry means: 'skip' (same name and hash in the folder), 'replace' (same name) or 'add'."""
    known = catalog.groupBy(*ENTRY_KEY).agg(F.collect_set(clean_hash(F.col("file_hash"))).alias("hashes"))
    joined = new.join(known, ENTRY_KEY, "left")
    action = F.when(F.col("hashes").isNull(), "add").when(F.coalesce(F.array_contains("hashes", clean_hash(F.col("file_hash"))), F.lit(False)), "skip").otherwise("replace")
    return joined.select("entry_id", *ENTRY_KEY, action.alias("action"))


def health(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """(folder_name, filename, document_id, status) of all entries and of orphaned indices.

    The first that holds: missing_pdf, missing_index, stale (the index was made from other content), healthy. An
    orphan is an index that no entry has.
    """
    made = index.groupBy("document_id").agg(F.min(clean_hash(F.col("file_hash"))).alias("indexed_hash"), F.lit(True).alias("indexed"))
    rows = catalog.join(made, "document_id", "left")
    status = (
        F.when(F.col("pdf_path").isNull(), "missing_pdf")
        .when(F.col("indexed").isNull(), "missing_index")
        .when(~clean_hash(F.col("file_hash")).eqNullSafe(F.col("indexed_hash")), "stale")
        .otherwise("healthy")
    )
    known = rows.select(*ENTRY_KEY, "document_id", status.alias("status"))
    orphans = index.join(catalog.select("document_id"), "document_id", "left_anti").select(*ENTRY_KEY, "document_id", F.lit("orphan").alias("status"))
    return known.unionByName(orphans)


def repair(statuses: DataFrame, remove_broken: bool = False) -> DataFrame:
    """What to do about each status that isn't healthy."""
    action = (
        F.when(F.col("status") == "missing_pdf", "remove_entry" if remove_broken else "warn")
        .when(F.col("status").isin("missing_index", "stale"), "reindex")
        .when(F.col("status") == "orphan", "delete_index")
    )
    return statuses.filter("status != 'healthy'").select(*ENTRY_KEY, "document_id", "status", action.alias("action"))


def first_entry(wanted: DataFrame, catalog: DataFrame, key: list[str], names: dict[str, str]) -> DataFrame:
    """Left join with the first entry (least ord, then entry_id) of each key; ``names`` renames its columns."""
    best = catalog.groupBy(*key).agg(F.min(F.struct("ord", "entry_id", *[c for c in names if c not in ("ord", "entry_id")])).alias("_first"))
    best = best.select(*key, *[F.col("_first")[c].alias(n) for c, n in names.items()])
    return wanted.join(best, key, "left")


def resolve(index: DataFrame, catalog: DataFrame) -> DataFrame:
    """The file behind each index: by document_id, then by folder and filename; (document_id, file_path, found_by)."""
    usable = catalog.filter("pdf_path is not null")
    rows = first_entry(index, usable.filter("document_id is not null"), ["document_id"], {"pdf_path": "by_id"})
    rows = first_entry(rows, usable, ENTRY_KEY, {"pdf_path": "by_name"})
    found = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "filename")
    return rows.select("document_id", F.coalesce("by_id", "by_name").alias("file_path"), found.alias("found_by"))


def time_ago(then: Column, now: str) -> Column:
    """How long before ``now`` (a literal, so that results can be repeated): unknown, just now, Nm, Nh or Nd ago."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    ago = lambda unit, letter: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{letter} ago"))
    return F.when(then.isNull(), "unknown").when(seconds < 60, "just now").when(seconds < 3600, ago(60, "m")).when(seconds < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))
