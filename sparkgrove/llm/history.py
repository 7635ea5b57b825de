"""New batches of files against everything accepted before, without another pass over the history.

An inverted index stands for the history. Of each accepted file name it holds the rarest tokens (a prefix of the
name's words in order of rarity), partitioned by token, and of each file hash the first entry accepted with it. A batch
probes the index with the prefixes of its own names; names of another length are filtered out, the others verified word
by word; then what the batch adds is appended. The index lies in a folder and is opened again by later sessions, which read
nothing of the history but the partitions that their tokens fall into.

Prefixes: names of three or more words of which up to ``SLIPS`` may be misspelt share at least one of their ``SLIPS + 1``
rarest tokens, whatever fixed order counts as rarity. The order is frozen when the index is created. In a name of one or
two words each may be misspelt, so its tokens are pieces of the first word (with the length of the second): a word is cut into ``SLIPS + 1`` pieces, of which as many
edits leave one whole, shifted by as many places at most; the probe looks for the pieces where they may then be. Tokens are qualified by the
place and the numbers of the name, which must agree exactly, so that no token gathers names that can't be the same.
"""

from __future__ import annotations

import json
import math
import posixpath
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.session import materialize, new_table_path

#: Words of a name that may be misspelt.
SLIPS = 2
#: Letters that a word must have for a slip to be one.
LEAST = 4
#: Postings of a partition of the index when it is created.
BUCKET = 200_000
#: Postings of a batch (8 bytes a token) up to which its tokens are broadcast; a larger one is joined by shuffling.
SMALL = 1_000_000
#: Where the share may be mounted; what follows is the place.
MOUNTS = (r"//filer\.test/share/", r"/(?:mnt|volumes)/share/", r"/srv/docs/", r"/data/incoming/", r"[a-z]:/(?!users/)")
#: Hashes that stand for no content: of nothing, or one digit repeated.
NO_CONTENT = r"^(d41d8cd98f00b204e9800998ecf8427e|(.)\2{31})$"
COPY_WORD = r"(?:copy|kopie|copie|copia|duplicate)"


def hash_key(column: Column) -> Column:
    """The 32 hexadecimal digits of an md5 in lower case, however written; null if there are none or they prove nothing."""
    digits = F.regexp_extract(F.lower(column), r"^[^0-9a-z]*(?:md5)?[^0-9a-z]*(?:0x)?([0-9a-f]{32})[^0-9a-z]*$", 1)
    return F.when((digits != "") & ~digits.rlike(NO_CONTENT), digits)


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold()) if not unicodedata.combining(c))


def name_words(filename: str | None) -> list[str]:
    """Words and numbers of a file name, without extension and marks added by copying."""
    name = fold(unquote(filename or "")).strip()
    while True:
        left = re.sub(r"\.pdf$", "", name).strip()
        left = re.sub(rf"(?:[\s_-]*\(\s*(?:\d+|{COPY_WORD})\s*\)|[\s_.-]+{COPY_WORD}(?:[\s_-]*\d+)?)$", "", left).strip()
        left = re.sub(rf"^{COPY_WORD}(?:[\s_-]*\(?\d+\)?)?[\s_-]+(?:of|von|de)[\s_-]+", "", left)
        if left == name:
            break
        name = left
    return [str(int(w)) if w.isdecimal() else w for w in re.split(r"[\W_]+", name) if w]


def place_of(path: str | None, mounts: Sequence[str] = MOUNTS) -> str | None:
    """The directory of a path below its mount, in one way of writing; None where it is unknown.

    ``mounts`` are patterns of where the share may be mounted; the first that fits is cut off.
    """
    path = fold(unquote((path or "").strip())).replace("\\", "/")
    path = re.sub(r"^file:/+", "/", re.sub(r"^smb:/*", "//", path))
    if "/" not in path:
        return None
    for mount in mounts:
        below = re.sub(f"^{mount}", "/", path)
        if below != path:
            path = below
            break
    folder = posixpath.dirname(posixpath.normpath("/" + path.lstrip("/")))
    return "/".join(re.sub(r"[\W_]+", " ", part).strip() for part in folder.split("/"))


def _cuts(length: int) -> list[tuple[int, int]]:
    """(start, end) of the SLIPS + 1 pieces of a word of so many letters, as even as can be."""
    at = [length * i // (SLIPS + 1) for i in range(SLIPS + 2)]
    return list(zip(at, at[1:]))


def piece_tokens(word: str) -> list[str]:
    """The pieces of a word that the index holds; the word itself if no slip is allowed in it."""
    if len(word) < LEAST:
        return [f"={word}"]
    return [f"{len(word)}.{i}.{word[a:b]}" for i, (a, b) in enumerate(_cuts(len(word)))]


def piece_probes(word: str) -> list[str]:
    """Where the pieces of a word that differs by up to SLIPS edits may be found in this one."""
    if len(word) < LEAST:
        return [f"={word}"]
    found = []
    for length in range(max(LEAST, len(word) - SLIPS), len(word) + SLIPS + 1):
        shift = len(word) - length
        for i, (a, b) in enumerate(_cuts(length)):
            # edits before the piece shift it by as many places; those after it leave the distance to the end
            low = max(0, a - i, a + shift - (SLIPS - i))
            high = min(len(word) - (b - a), a + i, a + shift + (SLIPS - i))
            found += [f"{length}.{i}.{word[k : k + b - a]}" for k in range(low, high + 1)]
    return list(dict.fromkeys(found))


def name_tokens(words: list[str], pieces: Callable[[str], list[str]], lengths: Callable[[int], Iterable[int]]) -> list[str]:
    """The tokens of a name of one or two words: the pieces of the first, each with the lengths that the other may have."""
    found = pieces(words[0])
    for word in words[1:]:
        ends = [f"={word}"] if len(word) < LEAST else [str(n) for n in lengths(len(word))]
        found = [f"{x} {end}" for x in found for end in ends]
    return found


def canonical(entries: DataFrame, mounts: Sequence[str] = MOUNTS) -> DataFrame:
    """Of each entry (entry_id, batch_no, file_hash, source_path, filename) the keys by which it is compared.

    Result: entry_id, batch_no, hash_key, place, words, pieces, probes, name_key; pieces and probes are those of names
    with one or two words, none for others. A null, blank or placeless name has no
    name_key, a hash without content no hash_key; an entry with neither repeats nothing. Entries with a null
    entry_id or batch_no are left out, repeated rows count once, other columns are ignored.
    """
    texts = pa.list_(pa.string())
    schema = pa.schema([("entry_id", pa.int64()), ("batch_no", pa.int32()), ("hash_key", pa.string()), ("place", pa.string()), ("words", texts), ("pieces", texts), ("probes", texts)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [place_of(p, mounts) for p in b.column(3).to_pylist()]
            words = [name_words(f) or None for f in b.column(4).to_pylist()]
            plain = [[w for w in ws or () if not any(map(str.isdigit, w))] for ws in words]
            pieces = [name_tokens(ws, piece_tokens, lambda n: [n]) if 0 < len(ws) <= SLIPS else None for ws in plain]
            probes = [name_tokens(ws, piece_probes, lambda n: range(max(LEAST, n - SLIPS), n + SLIPS + 1)) if 0 < len(ws) <= SLIPS else None for ws in plain]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(places, pa.string()), *(pa.array(x, texts) for x in (words, pieces, probes))], schema=schema)

    rows = entries.dropna(subset=["entry_id", "batch_no"]).dropDuplicates(["entry_id"])
    rows = rows.select(F.col("entry_id").cast("long"), F.col("batch_no").cast("int"), hash_key(F.col("file_hash")).alias("hash_key"), "source_path", "filename")
    rows = rows.mapInArrow(read, "entry_id long, batch_no int, hash_key string, place string, words array<string>, pieces array<string>, probes array<string>")
    return rows.withColumn("name_key", F.when(F.col("place").isNotNull() & F.col("words").isNotNull(), F.sha2(F.concat_ws("\n", "place", F.array_join("words", " ")), 256)))


def _numeric(word: Column) -> Column:
    return word.rlike(r"\p{Nd}")


def same_words(a: Column, b: Column) -> Column:
    """Whether two names of equal length differ in spelling only.

    Numbers and words of under four letters must agree; of the others up to SLIPS may differ by a slip: one or
    two letters put in, left out or changed, or two neighbours swapped; in words of under six letters only one.
    """
    def slip(x: Column, y: Column) -> Column:
        short = F.least(F.length(x), F.length(y))
        swapped = F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))
        edits = F.levenshtein(x, y)
        near = (edits <= 1) | ((edits == 2) & ((short >= 6) | swapped))
        return F.when(x == y, 0).when(_numeric(x) | _numeric(y) | (short < LEAST), SLIPS + 1).when(near, 1).otherwise(SLIPS + 1)

    return (F.size(a) == F.size(b)) & (F.aggregate(F.zip_with(a, b, slip), F.lit(0), lambda s, x: s + x) <= SLIPS)


class HistoryIndex:
    """The accepted entries as a rare-token index in a folder that all executors share.

    The folder holds the rarity of words, postings (a sub-folder per commit, in it one per bucket of tokens) and one file per commit. A commit is
    the last thing an append writes; postings without one are not read, so that an append cut short leaves no trace.
    """

    SCHEMA = "token long, key string, words array<string>, entry_id long, commit string, bucket int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = [json.loads(r.value) for r in spark.read.text(f"{path}/commits").collect()]  # one row per batch ever appended
        self.commits = [c["commit"] for c in found]
        self.buckets: int = found[0]["buckets"]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HistoryIndex:
        """The index in a folder, as the last append left it. Nothing of the history is read."""
        return cls(spark, path)

    @classmethod
    def create(cls, history: DataFrame, path: str | None = None, buckets: int | None = None) -> HistoryIndex:
        """A new index of canonical entries that are accepted whole, which are read once.

        ``buckets``: partitions of the tokens, by default one for ``BUCKET`` postings; a path in the shared folder by default.
        """
        spark = history.sparkSession
        self = cls.__new__(cls)
        self.spark, self.path, self.commits = spark, path or new_table_path(spark, "history-index"), []
        self.buckets = buckets or max(1, math.ceil(4 * history.count() / BUCKET))
        words = history.filter("name_key is not null").select(F.explode("words").alias("word"))
        words.groupBy("word").agg(F.count("*").alias("rarity")).write.parquet(f"{self.path}/words")
        self._append(self.postings(history))
        return self

    def postings(self, entries: DataFrame) -> DataFrame:
        """What the index holds of entries: token, key, words, entry_id (the first that has the key), bucket, kept, asked.

        kept: the index keeps the token; asked: a batch asks for it. Both, but for pieces of words. A hash is one token; of each distinct
        name there are the rarest words, or pieces, or the place and numbers where there is no word.
        """
        names = entries.filter("name_key is not null").groupBy("name_key").agg(F.min("entry_id").alias("entry_id"), *[F.first(c).alias(c) for c in ("place", "words", "pieces", "probes")])
        names = names.withColumn("frame", F.xxhash64("place", F.size("words"), F.array_join(F.filter("words", _numeric), " ")))
        plain = F.filter("words", lambda w: ~_numeric(w))
        order = self.spark.read.schema("word string, rarity long").parquet(f"{self.path}/words")
        tokens = names.filter(F.size(plain) > SLIPS).select("name_key", "frame", F.explode(F.array_distinct(plain)).alias("word")).join(order, "word", "left")
        tokens = tokens.select("name_key", F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), F.xxhash64("frame", "word").alias("token")).alias("t"))
        rarest = tokens.groupBy("name_key").agg(F.slice(F.array_sort(F.collect_list("t")), 1, SLIPS + 1)["token"].alias("tokens"))
        of_words = rarest.select("name_key", F.explode("tokens").alias("token"), F.lit(True).alias("kept"), F.lit(True).alias("asked"))

        def of_pieces(column: str) -> Column:
            return F.transform(column, lambda x: F.xxhash64("frame", x))

        both = F.array_union(of_pieces("pieces"), of_pieces("probes"))
        pieces = names.filter("pieces is not null").select("name_key", of_pieces("pieces").alias("kept"), of_pieces("probes").alias("asked"), F.explode(both).alias("token"))
        pieces = pieces.select("name_key", "token", F.array_contains("kept", F.col("token")).alias("kept"), F.array_contains("asked", F.col("token")).alias("asked"))
        bare = names.filter(F.size(plain) == 0).select("name_key", F.col("frame").alias("token"), F.lit(True).alias("kept"), F.lit(True).alias("asked"))
        named = of_words.unionByName(pieces).unionByName(bare).join(names.select("name_key", "words", "entry_id"), "name_key").withColumnRenamed("name_key", "key")
        hashed = entries.filter("hash_key is not null").groupBy(F.col("hash_key").alias("key")).agg(F.min("entry_id").alias("entry_id"))
        hashed = hashed.select(F.xxhash64("key").alias("token"), "key", F.lit(None).cast("array<string>").alias("words"), "entry_id", F.lit(True).alias("kept"), F.lit(True).alias("asked"))
        return named.unionByName(hashed).withColumn("bucket", F.pmod("token", F.lit(self.buckets)).cast("int"))

    def _append(self, postings: DataFrame) -> None:
        commit = f"{len(self.commits):08d}-{uuid.uuid4().hex}"
        rows = postings.filter("kept").select("token", "key", "words", "entry_id", F.lit(commit).alias("commit"), "bucket")
        rows.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("append").partitionBy("commit", "bucket").parquet(f"{self.path}/postings")
        # one small file, complete before its name appears among the commits
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        files = place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(place(f"{self.path}/draft-{commit}"), True)
        out.write(bytearray(json.dumps({"commit": commit, "buckets": self.buckets}).encode()))
        out.close()
        files.mkdirs(place(f"{self.path}/commits"))
        if not files.rename(place(f"{self.path}/draft-{commit}"), place(f"{self.path}/commits/{commit}")):
            raise RuntimeError(f"commit {commit} could not be written")
        self.commits.append(commit)

    def probe(self, own: DataFrame, postings: DataFrame) -> DataFrame:
        """(entry_id, accepted_id) of each entry of a batch that repeats an accepted one; the first such entry.

        ``own`` has (entry_id, key) of the batch, ``postings`` what the index would hold of it. Only the partitions of the index
        that hold a token of the batch are read.
        """
        asked = postings.filter("asked")
        hit = asked.groupBy("bucket").count().collect()  # at most self.buckets
        held = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/postings").filter(F.col("commit").isin(self.commits) & F.col("bucket").isin([r.bucket for r in hit]))
        held = held.select("token", F.col("key").alias("other_key"), F.col("words").alias("other"), F.col("entry_id").alias("accepted_id"))
        if sum(r["count"] for r in hit) <= SMALL:
            # the tokens of a small batch go to the index, so that only postings they hit are shuffled
            held = held.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")
        same = F.when(F.col("words").isNull(), F.col("key") == F.col("other_key")).otherwise(same_words(F.col("words"), F.col("other")))
        keys = asked.select("token", "key", "words").join(held, "token").filter(same).groupBy("key").agg(F.min("accepted_id").alias("accepted_id"))
        return own.join(keys, "key").groupBy("entry_id").agg(F.min("accepted_id").alias("accepted_id"))

    def judge(self, batch: DataFrame) -> DataFrame:
        """Decides a batch, appends what is accepted and returns (entry_id, accepted_id) of what repeats.

        Entries are judged in order of entry_id: one that is the same file as an accepted one before it is not accepted.
        Entries of the batch depend on each other only through common keys (a hash, a name, a similar name), so all
        whose earlier relations are decided are decided together; the rounds are as many as the longest chain of
        undecided entries. Relations are summed up per key, never listed pair by pair.
        """
        batch_keys = batch.select("entry_id", F.explode(F.array_compact(F.array("hash_key", "name_key"))).alias("key"))
        postings = materialize(self.postings(batch), "postings")
        known = materialize(self.probe(batch_keys, postings), "known")
        fresh = batch.join(known, "entry_id", "left_anti").select("entry_id")
        a, b = postings.filter("words is not null and asked").alias("a"), postings.filter("words is not null and kept").alias("b")
        similar = a.join(b, F.expr("a.token = b.token and a.key != b.key")).filter(same_words(F.col("a.words"), F.col("b.words"))).select(F.col("a.key").alias("key"), F.col("b.key").alias("other")).distinct()
        own = batch_keys.join(known, "entry_id", "left_anti")
        around = own.join(similar, "key").select("entry_id", F.col("other").alias("key"), F.lit(False).alias("own"))
        asked = materialize(own.withColumn("own", F.lit(True)).unionByName(around).groupBy("entry_id", "key").agg(F.max("own").alias("own")), "asked-keys")
        own, asked = asked.filter("own").select("entry_id", "key"), asked.select("entry_id", "key")
        state = fresh.select("entry_id", F.lit(None).cast("boolean").alias("accepted"))
        while True:
            first = own.join(state, "entry_id").filter("accepted is null or accepted").groupBy("key").agg(F.min(F.when(F.col("accepted"), F.col("entry_id"))).alias("taken"), F.min(F.when(F.col("accepted").isNull(), F.col("entry_id"))).alias("open"))
            around = asked.join(first, "key").groupBy("entry_id").agg(F.min("taken").alias("taken"), F.min("open").alias("open"))
            verdict = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("taken") < F.col("entry_id"), False).when(F.coalesce(F.col("open") >= F.col("entry_id"), F.lit(True)), True)
            state = materialize(state.join(around, "entry_id", "left").select("entry_id", verdict.alias("accepted")), "state")
            if state.filter("accepted is null").isEmpty():
                break
        # the first accepted entry of each key, now that all are decided: what others of the batch repeat, and what is appended
        first = own.join(state.filter("accepted").select("entry_id"), "entry_id").groupBy("key").agg(F.min("entry_id").alias("accepted_id"))
        inside = asked.join(first, "key").join(state.filter("not accepted").select("entry_id"), "entry_id", "left_semi").groupBy("entry_id").agg(F.min("accepted_id").alias("accepted_id"))
        found = materialize(known.unionByName(inside), "repeats")
        self._append(postings.drop("entry_id").join(first, "key").withColumnRenamed("accepted_id", "entry_id"))
        return found


def repeats(entries: DataFrame, mounts: Sequence[str] = MOUNTS) -> DataFrame:
    """(entry_id_a, entry_id_b) of all entries after batch 0 that repeat an accepted one, batch by batch."""
    keyed = materialize(canonical(entries, mounts), "entries", "batch_no")
    batches = sorted(r.batch_no for r in keyed.select("batch_no").distinct().collect() if r.batch_no > 0)  # one number per batch
    index = HistoryIndex.create(keyed.filter("batch_no = 0"))
    found = entries.sparkSession.createDataFrame([], "entry_id long, accepted_id long")
    for number in batches:
        found = found.unionByName(index.judge(keyed.filter(F.col("batch_no") == number)))
    return found.select(F.col("accepted_id").alias("entry_id_a"), F.col("entry_id").alias("entry_id_b"))
