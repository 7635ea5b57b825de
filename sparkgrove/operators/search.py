"""Search of folders and document trees by upper confidence bounds.

Which documents and nodes a search may see is found by joins; the search itself is a fold over arrays that hold one tree, run
inside the JVM for every (query, document) group by itself. A node is expanded first-come, in preorder, and a score is
computed once per (query, node), so that a search can be repeated exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.functions import scoring

ITERATIONS, MAX_DEPTH, TOP_K = 25, 10, 3
#: A leaf counts as settled with so many visits and such a mean.
SETTLED_VISITS, SETTLED_MEAN = 3, 0.7
#: Documents that a folder search can visit at most.
META_ITERATIONS, TOP_DOCUMENTS = 15, 3


def first_documents(catalog: DataFrame, limit: int = META_ITERATIONS) -> DataFrame:
    """The first documents of each folder, in its order; Spark limits each partition before it shuffles."""
    order = W.partitionBy("folder_name").orderBy("ord", "entry_id")
    return catalog.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def document_scores(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Relevance of every document of the folder that a question was asked in: query_id, entry_id, document_id, ord, score."""
    return questions.join(documents, "folder_name").select("query_id", "folder_name", "entry_id", "document_id", "filename", "ord", scoring.relevance(F.col("q_words"), F.col("d_words")).alias("score"))


def best_documents(scores: DataFrame, k: int = TOP_DOCUMENTS) -> DataFrame:
    """The k most relevant documents of each question; ties go to the earlier one in the folder."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "ord", "entry_id")
    return scores.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= k)


def flat_visits(arms: Column, pulls: Column) -> Column:
    """How often each arm of a flat bandit is pulled: array<int> for an array of scores.

    Every pull takes the arm with the greatest bound, an unvisited one first; the first of equals.
    """
    start = F.transform(arms, lambda r: F.lit(0))

    def pull(n: Column, t: Column) -> Column:
        bounds = F.zip_with(arms, n, lambda r, k: F.when(k == 0, F.lit(float("inf"))).otherwise(r + scoring.EXPLORATION * F.sqrt(F.log(t) / k)))
        at = F.array_position(bounds, F.array_max(bounds)) - 1
        return F.transform(n, lambda k, i: F.when(i == at, k + 1).otherwise(k))

    steps = F.when(pulls < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), pulls - 1))
    return F.aggregate(steps, start, lambda n, t: F.when(F.size(arms) == 0, n).otherwise(pull(n, t)))


def tree_arrays(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """One row per document: its nodes in preorder with their children and ancestors as positions in that order.

    A document is the unit that a search reads as a whole, so its nodes are gathered into one row.
    """
    order = W.partitionBy("document_id").orderBy("preorder", "node_id")
    placed = nodes.withColumn("at", F.row_number().over(order) - 1)
    at = placed.select("document_id", "node_id", "at")
    up = closure.join(at, ["document_id", "node_id"]).join(at.select("document_id", F.col("node_id").alias("ancestor_id"), F.col("at").alias("up")), ["document_id", "ancestor_id"])
    ancestors = up.groupBy("document_id", "node_id").agg(F.array_sort(F.collect_list("up")).alias("anc"))
    kids = up.filter("distance = 1").groupBy("document_id", F.col("ancestor_id").alias("node_id")).agg(F.array_sort(F.collect_list("at")).alias("kids"))
    rows = placed.join(ancestors, ["document_id", "node_id"]).join(kids, ["document_id", "node_id"], "left")
    rows = rows.withColumn("kids", F.coalesce("kids", F.array().cast("array<int>")))
    items = F.array_sort(F.collect_list(F.struct("at", "node_id", "n_words", "kids", "anc", "start_page", "end_page")))
    return rows.groupBy("document_id").agg(items.alias("nodes"))


#: One iteration: descend to a node that is a leaf or has an unvisited child, expand, score, add to all ancestors, and stop
#: early once enough leaves are settled. n and w are visits and rewards by position.
_DESCEND = f"""aggregate(sequence(1, {MAX_DEPTH}), 0, (c, d) -> CASE
    WHEN size(kids[c]) = 0 OR exists(kids[c], k -> s.n[k] = 0) THEN c
    ELSE transform(array(transform(kids[c], k -> s.w[k] / s.n[k] + {scoring.EXPLORATION}D * sqrt(ln(s.n[c]) / s.n[k]))), u -> kids[c][cast(array_position(u, array_max(u)) - 1 as int)])[0] END)"""
_TARGET = f"""transform(array({_DESCEND}), c -> coalesce(try_element_at(filter(kids[c], k -> s.n[k] = 0), 1), c))[0]"""
_STEP = f"""transform(array({_TARGET}), t -> named_struct(
    'n', transform(s.n, (x, j) -> if(array_contains(anc[t], j), x + 1, x)),
    'w', transform(s.w, (x, j) -> if(array_contains(anc[t], j), x + r[t], x)), 'steps', s.steps + 1, 'done', false))[0]"""
_SETTLED = f"size(filter(sequence(0, size(r) - 1), j -> size(kids[j]) = 0 AND x.n[j] >= {SETTLED_VISITS} AND x.w[j] / x.n[j] >= {SETTLED_MEAN}D)) >= {TOP_K}"
_FOLD = f"""aggregate(sequence(1, {ITERATIONS}), named_struct('n', transform(r, x -> 0), 'w', transform(r, x -> 0D), 'steps', 0, 'done', false),
    (s, i) -> if(s.done, s, transform(array({_STEP}), x -> named_struct('n', x.n, 'w', x.w, 'steps', x.steps, 'done', {_SETTLED}))[0]))"""


def tree_search(groups: DataFrame) -> DataFrame:
    """Searches a tree per row: needs ``nodes`` (of tree_arrays) and ``q_words``; adds ``r`` (scores) and ``s`` (n, w, steps, done)."""
    rows = groups.withColumn("r", F.transform("nodes", lambda x: scoring.rounded(scoring.relevance(F.col("q_words"), x["n_words"]))))
    rows = rows.withColumn("kids", F.col("nodes.kids")).withColumn("anc", F.col("nodes.anc"))
    return rows.withColumn("s", F.expr(_FOLD)).drop("kids", "anc")


def visited(searched: DataFrame, *keys: str) -> DataFrame:
    """One row per visited node: keys, at, node_id, visits, reward, mean and rank_score (rounded), pages, and whether it is a leaf."""
    rows = searched.select(*keys, F.posexplode("nodes").alias("at", "x"), "s")
    rows = rows.select(*keys, "at", "x.node_id", "x.start_page", "x.end_page", F.col("s.n")[F.col("at")].alias("visits"), F.col("s.w")[F.col("at")].alias("reward"), (F.size("x.kids") == 0).alias("leaf")).filter("visits > 0")
    return rows.withColumn("mean", scoring.rounded(scoring.mean_reward(F.col("reward"), F.col("visits")))).withColumn("rank_score", scoring.rounded(scoring.rank_score(F.col("reward"), F.col("visits"))))


def apart(found: DataFrame, *keys: str, k: int = TOP_K) -> DataFrame:
    """Per search up to k visited nodes by rank, none overlapping one taken before; ties in preorder.

    The nodes of one search, at most one per iteration and its ancestors, are folded in order; nodes without pages never overlap.
    """
    listed = F.array_sort(F.collect_list(F.struct((-F.col("rank_score")).alias("by"), "at", "node_id", "start_page", "end_page", "mean", "visits")))
    rows = found.groupBy(*keys).agg(listed.alias("found"))
    none = F.filter("found", lambda x: F.lit(False))

    def take(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda y: F.coalesce((x["start_page"] <= y["end_page"]) & (x["end_page"] >= y["start_page"]), F.lit(False)))
        return F.when((F.size(taken) >= k) | clash, taken).otherwise(F.concat(taken, F.array(x)))

    rows = rows.withColumn("taken", F.aggregate("found", none, take))
    return rows.select(*keys, F.posexplode("taken").alias("place", "x")).select(*keys, (F.col("place") + 1).alias("rank_no"), "x.node_id", "x.mean", "x.visits", "x.at", "x.start_page", "x.end_page")
