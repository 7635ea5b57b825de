"""Queries of the search over folders and trees.

Questions are the users' messages whose message_id is divisible by 100. phase1_topk, bandit_visits, phase2_search and ask keep the
reference's budget of the first fifteen documents of a folder; doc_scores, ask_routed and the queries that end in _full take all of its documents.
Only ask_routed answers questions without a usable folder too.
Searches by description take every indexed document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.functions import scoring
from sparkgrove.operators import chat, search, tree
from sparkgrove.plans.tree_queries import _NODES
from sparkgrove.session import materialize
from sparkgrove.sources import tables as t


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, folder_name, question, q_words."""
    rows = t.load(spark, sf_dir, "chat_messages").select("message_id", "role", "content", "folder_name")
    rows = rows.filter((F.col("message_id") % 100 == 0) & (F.lower(F.trim(F.regexp_replace("role", r"\s", ""))) == "user") & F.col("content").isNotNull()).dropDuplicates(["message_id"])
    return rows.select(F.col("message_id").alias("query_id"), "folder_name", F.col("content").alias("question"), scoring.words(F.col("content")).alias("q_words"))


def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions; where the folder is null or unknown, with the folder that the router falls back to."""
    asked, folders = questions(spark, sf_dir), t.load_once(spark, sf_dir, "folders")
    known = F.broadcast(folders.select("folder_name", F.col("folder_name").alias("known")))
    named = chat.named_folder(asked, folders).select("query_id", F.col("folder_name").alias("named"))
    rows = asked.join(known, "folder_name", "left").join(named, "query_id")
    return rows.select("query_id", F.coalesce("known", "named").alias("folder_name"), "question", "q_words")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed documents of the catalog with their words."""
    rows = t.load_once(spark, sf_dir, "folder_docs", "batch_no", "folder_name", "filename", "ord", "document_id", "summary", "keywords").filter("batch_no = 0 and document_id is not null")
    return rows.select("folder_name", "entry_id", "ord", "document_id", "filename", scoring.words(F.col("filename"), F.col("summary"), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")).alias("d_words"))


def _words_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t.current_nodes(spark, sf_dir, "parent_id", "preorder", "level", "title", "summary", "keywords", "start_page", "end_page")
    return nodes.withColumn("n_words", scoring.words(F.col("title"), F.col("summary"), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")))


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each indexed document's description as a query: document_id, folder_name, q_words."""
    rows = t.load_once(spark, sf_dir, "doc_index", "folder_name", "description")
    return rows.select("document_id", "folder_name", scoring.words(F.col("description")).alias("q_words"))


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = search.document_scores(questions(spark, sf_dir), documents(spark, sf_dir))
    return scores.select("query_id", "entry_id", scoring.rounded(F.col("score")).alias("score"))


def phase1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of the first fifteen documents of the folder, for each question."""
    scores = search.document_scores(questions(spark, sf_dir), search.first_documents(documents(spark, sf_dir)))
    return search.best_documents(scores).select("query_id", "rank_no", "entry_id", scoring.rounded(F.col("score")).alias("score"))


def phase1_topk_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of all documents of the folder."""
    scores = search.document_scores(questions(spark, sf_dir), documents(spark, sf_dir))
    return search.best_documents(scores).select("query_id", "rank_no", "entry_id", scoring.rounded(F.col("score")).alias("score"))


def bandit_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the flat search of a folder visits each of its first documents."""
    scores = search.document_scores(questions(spark, sf_dir), search.first_documents(documents(spark, sf_dir)))
    arms = scores.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "entry_id", scoring.rounded(F.col("score")).alias("score")))).alias("arms"))
    arms = arms.withColumn("visits", search.flat_visits(F.col("arms.score"), F.least(F.lit(search.META_ITERATIONS), F.size("arms") * 5)))
    return arms.select("query_id", F.inline(F.arrays_zip("arms.entry_id", "visits"))).toDF("query_id", "entry_id", "visits").filter("visits > 0")


def node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of every node to the description of its document."""
    rows = _words_of_nodes(spark, sf_dir).join(_descriptions(spark, sf_dir), "document_id")
    return rows.select("document_id", "node_id", scoring.rounded(scoring.relevance(F.col("q_words"), F.col("n_words"))).alias("score"))


def _backprop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = materialize(_words_of_nodes(spark, sf_dir), "nodes")
    scored = nodes.join(_descriptions(spark, sf_dir), "document_id").select("document_id", "node_id", scoring.rounded(scoring.relevance(F.col("q_words"), F.col("n_words"))).alias("score"))
    sums = tree.closure(nodes.select("document_id", "node_id", "parent_id")).join(scored, tree.NODE).groupBy("document_id", F.col("ancestor_id").alias("node_id"))
    sums = sums.agg(F.count("*").alias("visits"), F.sum(F.floor(F.col("score") * 1e6 + 0.5)).alias("reward_micro"))
    return sums.join(nodes.select("document_id", "node_id", "parent_id"), tree.NODE)


def backprop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits and rewards of every node when each node of its subtree is scored once."""
    return _backprop(spark, sf_dir).select("document_id", "node_id", "visits", "reward_micro")


def ucb1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_backprop(spark, sf_dir), "backprop")
    parents = rows.select("document_id", F.col("node_id").alias("parent_id"), F.col("visits").alias("parent_visits"))
    joined = rows.join(parents, ["document_id", "parent_id"], "left")
    return joined.select("document_id", "node_id", "visits", scoring.rounded(scoring.ucb1(F.col("reward_micro") / 1e6, F.col("visits"), F.col("parent_visits")), 1e4).alias("ucb1"))


def _trees(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The arrays of all documents, or of those in ``only``: the nodes of others are dropped before anything is done with them."""
    nodes = _words_of_nodes(spark, sf_dir)
    nodes = materialize(nodes.join(only.select("document_id").distinct(), "document_id", "left_semi") if only else nodes, "nodes")
    arrays = search.tree_arrays(nodes, tree.closure(nodes.select("document_id", "node_id", "parent_id")))
    return materialize(arrays, "trees")


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.tree_search(_trees(spark, sf_dir).join(_descriptions(spark, sf_dir), "document_id"))
    return materialize(found.select("document_id", "folder_name", "nodes", "s"), "searched")


def mcts_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of every node that the search of its document by description reaches."""
    return search.visited(_searched(spark, sf_dir), "document_id").select("document_id", "node_id", "visits", "mean")


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterations of each search and whether it ended early."""
    return _searched(spark, sf_dir).select("document_id", F.col("s.steps").alias("steps"), F.col("s.done").alias("stopped_early"))


def section_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.visited(_searched(spark, sf_dir), "document_id")
    order = W.partitionBy("document_id").orderBy(F.desc("rank_score"), "at")
    return rows.select("document_id", "node_id", "rank_score", F.row_number().over(order).alias("rank_no"))


def topk_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three sections per document that don't overlap."""
    return search.apart(search.visited(_searched(spark, sf_dir), "document_id"), "document_id").select("document_id", "rank_no", "node_id", "mean")


def global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sections of each folder."""
    rows = search.apart(search.visited(_searched(spark, sf_dir), "document_id", "folder_name"), "document_id", "folder_name")
    order = W.partitionBy("folder_name").orderBy(F.desc("mean"), "document_id", "rank_no")
    return rows.withColumn("place", F.row_number().over(order)).filter("place <= 3").select("folder_name", "place", "document_id", "node_id", "mean")


def _phase2(spark: SparkSession, sf_dir: str, asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sections found in the three best documents of each question's folder in the catalog."""
    best = materialize(search.best_documents(search.document_scores(asked, catalog)).select("query_id", "document_id", "filename", "rank_no"), "best")
    groups = best.join(asked.select("query_id", "q_words"), "query_id").join(_trees(spark, sf_dir, best), "document_id")
    found = search.visited(search.tree_search(groups), "query_id", "document_id", "filename")
    return search.apart(found, "query_id", "document_id", "filename")


def _cited(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """The three best of the found sections of each question, with their citations."""
    order = W.partitionBy("query_id").orderBy(F.desc("mean"), "document_id", "rank_no")
    best = found.withColumn("place", F.row_number().over(order)).filter("place <= 3")
    titles = t.current_nodes(spark, sf_dir, "title")
    rows = best.join(titles, tree.NODE)
    pages = F.coalesce(tree.page_range(F.col("start_page"), F.col("end_page")), F.lit("?"))
    cited = F.concat(F.lit("["), "filename", F.lit(" → "), F.coalesce("title", F.lit("Unknown")), F.lit(", "), pages, F.lit("]"))
    return rows.select("query_id", F.col("place").cast("int").alias("place"), "document_id", "node_id", "mean", cited.alias("citation"))


def phase2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the sections found in the three best of the first fifteen documents of its folder."""
    found = _phase2(spark, sf_dir, questions(spark, sf_dir), search.first_documents(documents(spark, sf_dir)))
    return found.select("query_id", "document_id", "rank_no", "node_id", "mean")


def phase2_search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the sections found in the three best of all documents of its folder."""
    return _phase2(spark, sf_dir, questions(spark, sf_dir), documents(spark, sf_dir)).select("query_id", "document_id", "rank_no", "node_id", "mean")


def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the three best sections over the first fifteen documents of its folder, with their citations."""
    return _cited(spark, sf_dir, _phase2(spark, sf_dir, questions(spark, sf_dir), search.first_documents(documents(spark, sf_dir))))


def ask_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the three best sections over all documents of its folder, with their citations."""
    return _cited(spark, sf_dir, _phase2(spark, sf_dir, questions(spark, sf_dir), documents(spark, sf_dir)))


def ask_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: ask_full over every question, those without a usable folder routed to one first."""
    return _cited(spark, sf_dir, _phase2(spark, sf_dir, materialize(routed_questions(spark, sf_dir), "asked"), documents(spark, sf_dir)))


def _r(value: str, unit: str = "1e6") -> str:
    """Rounded as scoring.rounded does it."""
    return f"floor(({value}) * {unit} + 0.5) / {unit}"


def _tokens(*columns: str) -> str:
    return f"list_distinct(list_filter(string_split(lower(concat_ws(' ', {', '.join(columns)})), ' '), lambda w: w <> ''))"


_KW = "array_to_string(coalesce(keywords, []), ' ')"
_REL = "CASE WHEN len(qw) = 0 THEN 0.0 ELSE len(list_intersect(qw, {0})) / len(qw) END"
_ASKED = f"""qs AS (SELECT DISTINCT message_id AS query_id, folder_name, {_tokens('content')} AS qw FROM chat_messages WHERE message_id % 100 = 0 AND lower(trim(regexp_replace(role, '\\s', '', 'g'))) = 'user' AND content IS NOT NULL),
    ds AS (SELECT DISTINCT folder_name, entry_id, ord, document_id, filename, {_tokens('filename', 'summary', _KW)} AS dw FROM folder_docs WHERE batch_no = 0 AND document_id IS NOT NULL),
    sc AS (SELECT query_id, qs.folder_name, entry_id, document_id, filename, ord, {_REL.format('dw')} AS score FROM qs JOIN ds USING (folder_name)),
    f15 AS (SELECT * FROM (SELECT entry_id, row_number() OVER (PARTITION BY folder_name ORDER BY ord, entry_id) AS place FROM ds) WHERE place <= {search.META_ITERATIONS}),
    top AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, entry_id) AS rank_no FROM sc JOIN f15 USING (entry_id)) WHERE rank_no <= {search.TOP_DOCUMENTS})"""
_NODEWORDS = _NODES.replace("'end_page': end_page}", "'end_page': end_page, 'keywords': keywords}") + f""",
    nw AS (SELECT document_id, node_id, parent_id, preorder, title, start_page, end_page, {_tokens('title', 'summary', _KW)} AS w FROM cur),
    de AS (SELECT DISTINCT document_id, folder_name, {_tokens('description')} AS qw FROM doc_index)"""
_NS = f"{_NODEWORDS}, ns AS (SELECT document_id, node_id, parent_id, {_r(_REL.format('w'))} AS score FROM nw JOIN de USING (document_id))"
_CLOSURE = """cl AS (SELECT document_id, node_id AS ancestor_id, node_id, 0 AS distance, parent_id FROM cur
        UNION ALL SELECT cl.document_id, c.node_id, cl.node_id, cl.distance + 1, c.parent_id FROM cl JOIN cur c ON c.document_id = cl.document_id AND c.node_id = cl.parent_id)"""
_BP = f"""{_NS}, {_CLOSURE}, bp AS (SELECT cl.document_id, cl.ancestor_id AS node_id, count(*) AS visits, CAST(sum(CAST(floor(ns.score * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS reward_micro FROM cl JOIN ns ON ns.document_id = cl.document_id AND ns.node_id = cl.node_id GROUP BY ALL)"""


def _fold(groups: str) -> str:
    """The tree search as a recursion of one descent step at a time; ``groups`` is a query of (g, document_id, qw)."""
    c, k, d = scoring.EXPLORATION, search.ITERATIONS, search.MAX_DEPTH
    return f"""
    pl AS (SELECT document_id, node_id, row_number() OVER (PARTITION BY document_id ORDER BY preorder, node_id) AS a, w, start_page, end_page FROM nw),
    ua AS (SELECT cl.document_id, p.a, u.a AS up, cl.distance FROM cl JOIN pl p ON p.document_id = cl.document_id AND p.node_id = cl.node_id JOIN pl u ON u.document_id = cl.document_id AND u.node_id = cl.ancestor_id),
    an AS (SELECT document_id, a, list(up ORDER BY up) AS anc FROM ua GROUP BY ALL),
    ki AS (SELECT document_id, up AS a, list(a ORDER BY a) AS kids FROM ua WHERE distance = 1 GROUP BY ALL),
    tr AS (SELECT pl.document_id, list(pl.w ORDER BY pl.a) AS ws, list(an.anc ORDER BY pl.a) AS anc, list(coalesce(ki.kids, []) ORDER BY pl.a) AS kids FROM pl JOIN an USING (document_id, a) LEFT JOIN ki USING (document_id, a) GROUP BY pl.document_id),
    gr AS ({groups}),
    st AS (SELECT g, gr.document_id, anc, kids, list_transform(ws, lambda w: {_r(_REL.format('w'))}) AS r FROM gr JOIN tr USING (document_id)),
    fo AS (SELECT g, document_id, anc, kids, r, list_transform(r, lambda x: 0) AS n, list_transform(r, lambda x: 0.0::DOUBLE) AS w, 1 AS c, 0 AS depth, 0 AS steps, false AS done FROM st
        UNION ALL
        SELECT g, document_id, anc, kids, r,
            CASE WHEN stop THEN list_transform(n, lambda x, j: CASE WHEN list_contains(anc[t], j) THEN x + 1 ELSE x END) ELSE n END,
            CASE WHEN stop THEN list_transform(w, lambda x, j: CASE WHEN list_contains(anc[t], j) THEN x + r[t] ELSE x END) ELSE w END,
            CASE WHEN stop THEN 1 ELSE nxt END, CASE WHEN stop THEN 0 ELSE depth + 1 END, CASE WHEN stop THEN steps + 1 ELSE steps END,
            CASE WHEN stop THEN len(list_filter(range(1, len(r) + 1), lambda j: len(kids[j]) = 0 AND n[j] + CASE WHEN list_contains(anc[t], j) THEN 1 ELSE 0 END >= {search.SETTLED_VISITS}
                AND (w[j] + CASE WHEN list_contains(anc[t], j) THEN r[t] ELSE 0 END) / greatest(n[j] + CASE WHEN list_contains(anc[t], j) THEN 1 ELSE 0 END, 1) >= {search.SETTLED_MEAN})) >= {search.TOP_K} ELSE false END
        FROM (SELECT *, CASE WHEN stop THEN 1 ELSE kids[c][list_position(u, list_max(u))] END AS nxt FROM (
            SELECT *, (len(kids[c]) = 0 OR len(fresh) > 0 OR depth >= {d}) AS stop, coalesce(fresh[1], c) AS t,
                list_transform(kids[c], lambda k: w[k] / greatest(n[k], 1) + {c} * sqrt(ln(greatest(n[c], 1)) / greatest(n[k], 1))) AS u
            FROM (SELECT *, list_filter(kids[c], lambda k: n[k] = 0) AS fresh FROM fo WHERE NOT done AND steps < {k}))))
    , en AS (SELECT * FROM fo WHERE (done OR steps = {k}) AND c = 1 AND depth = 0),
    vi AS (SELECT g, document_id, a, n[a] AS visits, w[a] AS reward FROM (SELECT g, document_id, n, w, unnest(range(1, len(n) + 1)) AS a FROM en) WHERE n[a] > 0),
    rk AS (SELECT vi.g, vi.document_id, pl.node_id, vi.a, visits, start_page, end_page, {_r('reward / visits')} AS mean, {_r('reward / visits * ln(visits + 1)')} AS rank_score FROM vi JOIN pl USING (document_id, a)),
    od AS (SELECT *, row_number() OVER (PARTITION BY g, document_id ORDER BY rank_score DESC, a) AS i FROM rk),
    gd AS (SELECT g, document_id, list({{'node_id': node_id, 's': start_page, 'e': end_page, 'mean': mean}} ORDER BY i) AS f FROM od GROUP BY ALL),
    tk AS (SELECT g, document_id, f, 1 AS i, [] :: STRUCT(node_id VARCHAR, s INTEGER, e INTEGER, mean DOUBLE)[] AS got FROM gd
        UNION ALL SELECT g, document_id, f, i + 1, CASE WHEN len(got) >= {search.TOP_K} OR len(list_filter(got, lambda y: coalesce(f[i].s <= y.e AND f[i].e >= y.s, false))) > 0 THEN got ELSE list_append(got, f[i]) END FROM tk WHERE i <= len(f)),
    ap AS (SELECT g, document_id, CAST(j AS INTEGER) AS rank_no, got[j].node_id AS node_id, got[j].mean AS mean FROM (SELECT g, document_id, got, unnest(range(1, len(got) + 1)) AS j FROM tk WHERE i = len(f) + 1))"""


_BYDOC = f"{_NODEWORDS}, {_CLOSURE}, {_fold('SELECT document_id AS g, document_id, qw FROM de')}"
_BYQ = f"{_NODEWORDS}, {_CLOSURE}, {_ASKED}, {_fold('SELECT DISTINCT top.query_id AS g, top.document_id, qs.qw FROM top JOIN qs USING (query_id)')}"
_BANDIT = f"""WITH RECURSIVE {_ASKED}, ar AS (SELECT query_id, list({{'e': entry_id, 's': {_r('score')}}} ORDER BY ord, entry_id) AS arms FROM sc JOIN f15 USING (entry_id) GROUP BY query_id),
    bd AS (SELECT query_id, arms, list_transform(arms, lambda x: 0) AS n, 0 AS t FROM ar
        UNION ALL SELECT query_id, arms, list_transform(n, lambda x, j: CASE WHEN j = list_position(b, list_max(b)) THEN x + 1 ELSE x END), t + 1
        FROM (SELECT *, list_transform(n, lambda x, j: CASE WHEN x = 0 THEN 'infinity'::DOUBLE ELSE arms[j].s + {scoring.EXPLORATION} * sqrt(ln(greatest(t, 1)) / greatest(x, 1)) END) AS b FROM bd WHERE t < least({search.META_ITERATIONS}, len(arms) * 5)))
    SELECT query_id, arms[j].e AS entry_id, n[j] AS visits FROM (SELECT *, unnest(range(1, len(n) + 1)) AS j FROM bd WHERE t = least({search.META_ITERATIONS}, len(arms) * 5)) WHERE n[j] > 0"""

SQL = {
    "doc_scores": f"WITH {_ASKED} SELECT query_id, entry_id, {_r('score')} AS score FROM sc",
    "phase1_topk": f"WITH {_ASKED} SELECT query_id, CAST(rank_no AS INTEGER) AS rank_no, entry_id, {_r('score')} AS score FROM top",
    "phase1_topk_full": f"""WITH {_ASKED} SELECT query_id, CAST(rank_no AS INTEGER) AS rank_no, entry_id, {_r('score')} AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, entry_id) AS rank_no FROM sc) WHERE rank_no <= {search.TOP_DOCUMENTS}""",
    "bandit_visits": _BANDIT,
    "node_scores": f"{_NS} SELECT document_id, node_id, score FROM ns",
    "backprop": f"{_BP} SELECT document_id, node_id, visits, reward_micro FROM bp",
    "ucb1_scores": f"""{_BP} SELECT b.document_id, b.node_id, b.visits, {_r(f'CASE WHEN p.visits IS NULL THEN b.reward_micro / 1e6 / b.visits ELSE b.reward_micro / 1e6 / b.visits + {scoring.EXPLORATION} * sqrt(ln(p.visits) / b.visits) END', '1e4')} AS ucb1
        FROM bp b JOIN cur c ON c.document_id = b.document_id AND c.node_id = b.node_id LEFT JOIN bp p ON p.document_id = b.document_id AND p.node_id = c.parent_id""",
    "mcts_visits": f"{_BYDOC} SELECT document_id, node_id, CAST(visits AS INTEGER) AS visits, mean FROM rk",
    "early_stop": f"{_BYDOC} SELECT document_id, CAST(steps AS INTEGER) AS steps, done AS stopped_early FROM en",
    "section_rank": f"{_BYDOC} SELECT document_id, node_id, rank_score, CAST(i AS INTEGER) AS rank_no FROM od",
    "topk_nonoverlap": f"{_BYDOC} SELECT document_id, rank_no, node_id, mean FROM ap",
    "global_topk": f"""{_BYDOC} SELECT folder_name, CAST(place AS INTEGER) AS place, document_id, node_id, mean FROM (SELECT de.folder_name, ap.document_id, ap.node_id, ap.mean,
        row_number() OVER (PARTITION BY de.folder_name ORDER BY mean DESC, ap.document_id, rank_no) AS place FROM ap JOIN de ON de.document_id = ap.document_id) WHERE place <= 3""",
    "phase2_search": f"{_BYQ} SELECT g AS query_id, document_id, rank_no, node_id, mean FROM ap",
    "ask": f"""{_BYQ} SELECT query_id, CAST(place AS INTEGER) AS place, document_id, node_id, mean, '[' || filename || ' → ' || coalesce(title, 'Unknown') || ', ' ||
        coalesce(CASE WHEN start_page = end_page THEN 'p.' || (start_page + 1) ELSE 'pp.' || (start_page + 1) || '-' || (end_page + 1) END, '?') || ']' AS citation
        FROM (SELECT ap.g AS query_id, ap.document_id, ap.node_id, ap.mean, top.filename, row_number() OVER (PARTITION BY ap.g ORDER BY ap.mean DESC, ap.document_id, ap.rank_no) AS place
              FROM ap JOIN top ON top.query_id = ap.g AND top.document_id = ap.document_id) x JOIN nw USING (document_id, node_id) WHERE place <= 3""",
}
_ALL = _ASKED.replace("FROM sc JOIN f15 USING (entry_id)) WHERE rank_no", "FROM sc) WHERE rank_no")
SQL |= {f"{name}_full": SQL[name].replace(_ASKED, _ALL) for name in ("phase2_search", "ask")}
_ROUTED = f"""rt AS (SELECT DISTINCT message_id AS query_id, folder_name AS own, content FROM chat_messages WHERE message_id % 100 = 0 AND lower(trim(regexp_replace(role, '\\s', '', 'g'))) = 'user' AND content IS NOT NULL),
    nm AS (SELECT query_id, min(f.folder_name) AS named FROM rt JOIN folders f ON contains(lower(content), lower(f.folder_name)) GROUP BY query_id),
    qs AS (SELECT query_id, CASE WHEN own IN (SELECT folder_name FROM folders) THEN own ELSE coalesce(named, (SELECT min(folder_name) FROM folders)) END AS folder_name, {_tokens('content')} AS qw FROM rt LEFT JOIN nm USING (query_id))"""
SQL["ask_routed"] = SQL["ask"].replace(_ASKED, _ROUTED + _ALL[_ALL.index(",\n    ds AS"):])
QUERIES = {name: globals()[name] for name in SQL}
