"""Keyword-stuffed and link-list pages.

Two kinds of evidence are joined per page. Lists: the parts of a page (its lines and sentences) that have hardly any
function word are listed rather than written; parts that repeat one of the page's own keywords again and again are stuffed.
Phrases: the phrases of all pages are exploded and the distinct hosts counted that each occurs under. A page is spam if it
is mostly listed or stuffed, and that matter is mostly stitched from phrases that stand elsewhere too. A list of things
that nobody else names is no spam, nor is prose, however often its phrases return.

A phrase is a pair of neighbouring words between separators, or a single word that stands alone there, as keywords, menu
items and the words of a link's path have one to three words. Words with digits part phrases, as numbers,
product codes and ids don't recur. Everything is computed by expressions inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrove.session import materialize

#: A part with at most this share of function words is listed.
WRITTEN = 0.12
#: A keyword occurs so often on the page, makes up so much of its words, and is repeated within its parts so many times over.
TIMES, OFTEN, REPEATED = 3, 0.02, 1.25
#: A part is stuffed if keywords are so much of it, each counted as one word.
STUFFED = 0.25
#: Hosts under which a phrase must occur, and the shares that count as most: of the page listed, and of that stitched.
HOSTS, LISTED, STITCHED = 2, 0.5, 0.5

#: Function words of six languages. Those that join the words of a name (of, de, du) are left out.
FUNCTION_WORDS = (
    "the and is was to with that has have not by from it which are were this be been each because before after only did does how who where there they their about you i we he she as at on if so than what when your our can could would will should may must an or no any but into between during then these those had its his her them until in "
    "der die das und ist nicht ein eine einen einer einem zu den dem mit für auf im wird werden ob sich bei nach seit wie wer wann warum zum zur noch dieser dieses muss müssen kann wurde wir hat am ich von vom aus als auch es er sie dass damit unter alle durch bis "
    "le les est et une dans pour sur avec qui ne pas cette ce au aux il ils elle selon non nous vous être été sont son ses sa avant après par plus que où se si a un en toute doit "
    "el los las y una con para por según este esta al su sus lo como más cada debe ser desde son ha han fue donde antes "
    "и в не на я он с что а по это к но они мы из у за от со для до как был была было были или же бы все при о"
).split()
#: Cyrillic letters that look like Latin ones, and those.
ALIKE = ("аеорсхуі", "aeopcxyi")

_BREAKS = r"[\n\r\u000b\f\u0085\u2028\u2029。]+|[.!?]\s+"
_SEPARATORS = r" [-_]+ |[^\p{L}\p{M}\p{N}' _¶-]+"
_INVISIBLE = "\u00ad\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff¶"


def _clean(text: Column) -> Column:
    """The page in lower case, its parts parted by ¶ and its separators turned to bars."""
    # the invisible are replaced by nothing, as translate does with what has no counterpart
    clean = F.translate(text, ALIKE[0] + _INVISIBLE, ALIKE[1])
    clean = F.when(text.contains("#"), F.regexp_replace(clean, r"(\p{Ll})(\p{Lu})", "$1 $2")).otherwise(clean)
    clean = F.lower(F.when(text.contains("<"), F.regexp_replace(clean, r"</?[a-zA-Z]+(?:\s+href)?", "<")).otherwise(clean))
    return F.translate(F.regexp_replace(F.regexp_replace(clean, _BREAKS, " ¶ "), _SEPARATORS, " | "), "-_", "  ")


def _parts(text: Column) -> Column:
    """Lines and sentences of a page: chars (letters, roughly), words, function words, and phrases as hashes.

    The lowest bit of a hash tells whether all words of the phrase are content.
    """
    function = sorted({w.translate(str.maketrans(*ALIKE)) for w in FUNCTION_WORDS})
    def phrases(ts: Column, marks: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            mine, following = F.get(marks, i), F.coalesce(F.get(marks, i + 1), F.lit(2))
            alone = (following == 2) & (F.coalesce(F.get(marks, i - 1), F.lit(2)) == 2)
            key = F.when(mine == 2, None).when(following != 2, F.xxhash64(word, F.get(ts, i + 1))).when(alone, F.xxhash64(word))
            return F.shiftleft(F.shiftright(key, 1), 1) + F.when((mine == 1) | (following == 1), F.lit(0)).otherwise(F.lit(1))

        return F.array_compact(F.transform(ts, at))

    def part(row: Column) -> Column:
        ts, marks = row["tokens"], row["marks"]
        words = F.size(F.filter(marks, lambda m: m != 2))
        # what stands alone between separators joins nothing
        joins = F.filter(marks, lambda m, i: (m == 1) & ((F.coalesce(F.get(marks, i + 1), F.lit(2)) < 2) | (F.coalesce(F.get(marks, i - 1), F.lit(2)) < 2)))
        written = F.when(row["kana"], words + 1).otherwise(F.size(joins))
        return F.struct(row["chars"].alias("chars"), words.alias("words"), written.alias("function"), phrases(ts, marks).alias("phrases"))

    def marked(row: Column) -> Column:
        # of each token: 0 content, 1 function word, 2 separator, as are words with digits
        marks = F.transform(row["tokens"], lambda w: F.when((w == "|") | w.rlike(r"\p{N}"), 2).when(w.isin(function), 1).otherwise(0))
        return F.struct(row["chars"].alias("chars"), row["kana"].alias("kana"), row["tokens"].alias("tokens"), marks.alias("marks"))

    def split(p: Column) -> Column:
        # hiragana writes the particles of Japanese, which has no blanks: a part that holds any is written
        return F.struct(F.length(F.replace(p, F.lit(" "))).alias("chars"), p.rlike(r"[\u3041-\u309f]").alias("kana"), F.filter(F.split(p, " "), lambda w: w != "").alias("tokens"))

    rows = F.transform(F.split(_clean(text), "¶"), split)
    return F.transform(F.transform(F.filter(rows, lambda r: r["chars"] > 0), marked), part)


def _content(phrase: Column) -> Column:
    return phrase.bitwiseAND(F.lit(1)) == 1


def _keywords(parts: Column) -> Column:
    """Phrases of content that the page repeats within its parts; at most 1 / OFTEN of them, so that looking for each is cheap."""
    every = F.array_sort(F.flatten(F.transform(parts, lambda p: F.filter(p["phrases"], _content))))
    once = F.flatten(F.transform(parts, lambda p: F.array_distinct(F.filter(p["phrases"], _content))))
    words = F.aggregate(parts, F.lit(0), lambda s, p: s + p["words"])
    least = F.greatest(F.lit(TIMES), F.ceil(words * OFTEN).cast("int"))

    def chosen(lists: Column) -> Column:
        sorted_, single, reach = lists["every"], lists["once"], lists["least"]
        frequent = F.array_distinct(F.filter(sorted_, lambda x, i: F.get(sorted_, i + reach - 1) == x))
        return F.filter(frequent, lambda x: F.size(F.filter(sorted_, lambda y: y == x)) >= REPEATED * F.size(F.filter(single, lambda y: y == x)))

    # a list of one, so that the arrays are computed once for all phrases
    return F.transform(F.array(F.struct(every.alias("every"), once.alias("once"), least.alias("least"))), chosen)[0]


def evidence(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, host, total, listed, listed_only, evidence, phrases) of every row with text; no shuffle.

    total: characters of the page; listed: of its parts that are listed or stuffed; listed_only: without the stuffed ones;
    evidence: their phrases, each with the characters it stands for; phrases: the distinct phrases of the page.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), _parts(F.col(text)).alias("parts"))
    # a generator between the steps, or the optimizer would merge them and compute the parts again for each use
    rows = rows.select("key", "host", F.explode(F.array("parts")).alias("parts"))
    rows = rows.select("key", "host", F.explode(F.array(F.struct("parts", _keywords(F.col("parts")).alias("keywords")))).alias("page"))

    def judged(part: Column) -> Column:
        known, phrases = F.col("page.keywords"), part["phrases"]
        keys = F.filter(phrases, lambda x: F.array_contains(known, x))
        listed = (part["words"] > 0) & (part["function"] <= WRITTEN * part["words"])
        # a keyword of several words is a run of phrases, and counts as one word
        runs = F.size(F.filter(phrases, lambda x, i: F.array_contains(known, x) & ~F.coalesce(F.array_contains(known, F.get(phrases, i - 1)), F.lit(False))))
        stuffed = (runs > 0) & (runs >= STUFFED * (part["words"] - F.size(keys)))
        return F.struct(part["chars"].alias("chars"), listed.alias("listed"), stuffed.alias("stuffed"), F.when(listed, part["phrases"]).when(stuffed, keys).otherwise(F.array().cast("array<bigint>")).alias("phrases"))

    rows = rows.select("key", "host", F.array_distinct(F.flatten("page.parts.phrases")).alias("phrases"), F.explode(F.array(F.transform("page.parts", judged))).alias("parts"))

    def chars(which: Column | None) -> Column:
        return F.aggregate(F.col("parts") if which is None else F.filter("parts", which), F.lit(0).cast("long"), lambda s, p: s + p["chars"])

    shares = F.flatten(F.transform("parts", lambda p: F.transform(p["phrases"], lambda x: F.struct(x.alias("phrase"), (p["chars"] / F.size(p["phrases"])).cast("float").alias("chars")))))
    return rows.select("key", "host", chars(None).alias("total"), chars(lambda p: p["listed"] | p["stuffed"]).alias("listed"), chars(lambda p: p["listed"]).alias("listed_only"), shares.alias("evidence"), "phrases").filter("total > 0")


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, list_share, plain_list_share, stitched_share, spam) of every page with text.

    list_share: of the page listed or stuffed; plain_list_share: listed; stitched_share: of the listed and stuffed matter, what
    lies in phrases that occur under ``HOSTS`` hosts, or again on the page. spam: both more than half.

    Repeated rows of a key count once, rows with a null key are left out; null, empty and blank texts give no row; a null host counts as
    one host of its own. Copies under other keys are judged one by one. An empty table gives an empty result.

    Texts are read once and never shuffled. Hosts are counted over the phrases of all pages, per (phrase, host) before the shuffle,
    so that a phrase or host that holds a third of all rows arrives as one row a task. What is looked up is each page's
    phrases in listed or stuffed parts; a hot phrase is split by Spark's handling of skewed joins.
    """
    kind = docs.schema[key].dataType
    rows = materialize(evidence(docs.dropna(subset=[key]).filter(F.col(text).isNotNull()), key, text, host), "pages")
    hosts = rows.select("host", F.explode("phrases").alias("phrase")).distinct().groupBy("phrase").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= HOSTS)
    pages = rows.select("key", "total", "listed", "listed_only", "evidence").dropDuplicates(["key"])
    stands = pages.filter("listed > 0").select("key", F.explode("evidence").alias("e")).groupBy("key", F.col("e.phrase").alias("phrase")).agg(F.count("*").alias("times"), F.sum("e.chars").alias("chars"))
    found = stands.join(hosts, "phrase", "left").groupBy("key").agg(F.sum("chars").alias("in_phrases"), F.sum(F.when((F.col("hosts") >= HOSTS) | (F.col("times") >= 2), F.col("chars")).otherwise(0.0)).alias("stitched"))
    both = pages.drop("evidence").join(found, "key", "left")
    share, stitched = F.col("listed") / F.col("total"), F.coalesce(F.try_divide("stitched", "in_phrases"), F.lit(0.0))
    return both.select(F.col("key").cast(kind).alias(key), share.alias("list_share"), (F.col("listed_only") / F.col("total")).alias("plain_list_share"), stitched.alias("stitched_share"), ((share > LISTED) & (stitched > STITCHED)).alias("spam"))
