"""Chats about documents: history, cited sources, answer contexts, routing and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.functions import scoring

#: Messages that a router sees, and characters of each.
TAIL, SHOWN = 6, 200
#: Confidence of a folder whose name the question holds, and of the first folder otherwise.
NAMED, FALLBACK = 0.7, 0.3
#: Price of a million input and output tokens.
INPUT_PRICE, OUTPUT_PRICE = 2.5, 10.0


def role_of(role: Column) -> Column:
    """The role in lower case without white space."""
    return F.lower(F.regexp_replace(role, r"\s", ""))


def history_tail(messages: DataFrame, n: int = TAIL) -> DataFrame:
    """The last n messages of each conversation, shortened as a router sees them; a null content is empty."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n)
    return last.select("conv_id", "turn", "back", F.concat(F.initcap(role_of(F.col("role"))), F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, SHOWN)).alias("line"))


def cards(messages: DataFrame) -> DataFrame:
    """One row per cited source of a message: conv_id, turn, place (from 0), document, section, pages, score (3 digits)."""
    rows = messages.select("conv_id", "turn", F.posexplode("sources").alias("place", "x"))
    return rows.select("conv_id", "turn", "place", "x.document", "x.section", "x.pages", F.round("x.score", 3).alias("score"))


def citation(document: Column, section: Column, pages: Column) -> Column:
    """[document → section, pages], without the document where it is unknown."""
    rest = F.concat(F.coalesce(section, F.lit("Unknown")), F.lit(", "), F.coalesce(pages, F.lit("?")), F.lit("]"))
    return F.when(F.coalesce(document, F.lit("")) == "", F.concat(F.lit("["), rest)).otherwise(F.concat(F.lit("["), document, F.lit(" → "), rest))


def rerank(found: DataFrame) -> DataFrame:
    """Sources ordered again after a second reading: those whose section is unknown are not confirmed and lose most of their score."""
    score = F.coalesce(F.col("score"), F.lit(scoring.NEUTRAL)) * F.when(F.col("section").isNull(), scoring.UNCONFIRMED).otherwise(1.0)
    rows = found.withColumn("adjusted", F.round(score, 6))
    order = W.partitionBy("conv_id", "turn").orderBy(F.desc("adjusted"), "place")
    return rows.select("conv_id", "turn", "place", "adjusted", F.row_number().over(order).alias("rank_no"))


def contexts(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, context): the source blocks of a message as one text, in their order."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    blocks = F.transform("sources", lambda x, i: F.concat(F.lit("--- Source "), (i + 1).cast("string"), F.lit(": "), text(x["document"]), F.lit(" → "), text(x["section"]), F.lit(" ("), text(x["pages"]), F.lit(") ---")))
    return messages.filter(F.size("sources") > 0).select("conv_id", "turn", F.array_join(blocks, "\n").alias("context"))


def named_folder(questions: DataFrame, folders: DataFrame) -> DataFrame:
    """(query_id, folder_name, confidence): the first folder, by name, that a question names, else the first of all."""
    names = folders.select(F.col("folder_name").alias("name")).distinct()
    first = names.agg(F.min("name").alias("first_name"))
    # the folders are a fixed, small table, the questions a stated query set
    pairs = questions.select("query_id", "question").join(F.broadcast(names), F.contains(F.lower("question"), F.lower("name")))
    named = pairs.groupBy("query_id").agg(F.min("name").alias("named"))
    rows = questions.select("query_id").join(named, "query_id", "left").crossJoin(F.broadcast(first))
    return rows.select("query_id", F.coalesce("named", "first_name").alias("folder_name"), F.when(F.col("named").isNull(), FALLBACK).otherwise(NAMED).alias("confidence"))


def usage(messages: DataFrame) -> DataFrame:
    """Per folder: answers with statistics, calls, reported cost, and the cost of their words at the list prices."""
    number = lambda key: F.expr(f"try_cast(replace(stats['{key}'], '$', '') as double)")
    words = F.when(F.coalesce(F.trim("content"), F.lit("")) == "", 0).otherwise(F.size(F.split(F.trim("content"), " +")))
    asked, answered = role_of(F.col("role")) == "user", role_of(F.col("role")) == "assistant"
    rows = messages.groupBy("folder_name").agg(
        F.count_if(F.size("stats") > 0).alias("answers"), F.sum(number("llm_calls").cast("long")).alias("calls"), F.round(F.sum(number("cost")), 4).alias("reported_cost"),
        F.sum(F.when(asked, words).otherwise(0)).alias("input_words"), F.sum(F.when(answered, words).otherwise(0)).alias("output_words"),
    )
    return rows.withColumn("list_cost", F.round(F.col("input_words") / 1e6 * INPUT_PRICE + F.col("output_words") / 1e6 * OUTPUT_PRICE, 4))
