"""Defects of question-answer pairs: empty, copied, refusing, truncated or foreign answers.

A pair is an assistant's message with the user's message right before it (system messages aside). Conversations are
cut into blocks of turns, so that a conversation of any length is paired by many tasks. Answers are judged by
expressions inside the JVM. Refusals are found from the corpus itself: the openings of all answers are clustered by verified
MinHash, and a cluster is a template of refusals if it recurs under unrelated questions, if its answers don't go
on with something of their own, and if some of them apologize or decline; the others then refuse without that.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.session import materialize

#: Turns of one block of a conversation.
TURNS = 1024
#: Words of an opening (a short one too, as what is asked about may follow early), letters of a shingle, and the similarity from
#: which two openings are the same.
OPENING, BRIEF, SHINGLE, SIMILAR = 6, 4, 3, 0.8
#: MinHash: bands of so many hashes each; two openings that are 0.8 similar miss all bands in under 1 % of the cases.
BANDS, ROWS = 8, 3
#: Unrelated questions under which an opening must recur, and the least share of its answers that apologize or decline.
RECURS, DECLINES = 3, 0.15
#: A template informs if at least half of its answers go on differently, so many ways at least.
WAYS = 8

#: Function words and other words by which a language is told; words shared by two of the languages are left out.
WORDS = {
    "en": "the of and is was to for with that has have not by from it which are were this be been each please because before after only did does how who where yes there they their about percent section you your i my any our than what when it's don't can't replaces cover earlier glad welcome happy help again page pages could would",
    "de": "der die das und ist nicht ein eine einen einer zu den dem mit für von auf im wird werden ob sich bei nach seit wie wer wann warum welche ja nein siehe seite über zum zur noch dieser dieses jahr muss müssen kann kurz gesagt laut gilt bevor wurde wir hat am ich leider mich tut mir es",
    "fr": "le les des du est et une dans pour sur avec qui ne pas cette ce au aux il ils selon oui non voir depuis nous vous être été sont son ses avant après toute doit par plus reste pourra quelle quelles quand c'est l'a d'après résumé rapport à je n'a montant s'élève chaque page quel quelques mais",
    "es": "el los las del y una en para con por se sí según este esta al su sus lo como más cada debe ser podrá antes desde qué cuál cuándo quién cómo dónde véase página puede está son ha han fue pero nos recomendamos queda próxima sobre me muy",
}
#: How a question asks for an answer in another language.
ASKS = {
    "en": r"\b(in english|auf englisch|en anglais|en inglés)\b",
    "de": r"\b(in german|auf deutsch|en allemand|en alemán)\b",
    "fr": r"\b(in french|auf französisch|en français|en francés)\b",
    "es": r"\b(in spanish|auf spanisch|en espagnol|en español)\b",
    "ru": r"\b(in russian|auf russisch|en russe|en ruso)\b",
    "ja": r"\b(in japanese|auf japanisch|en japonais|en japonés)\b",
}
#: What stands for a missing text.
PLACEHOLDERS = ("na", "n a", "null", "nil", "nan", "undefined", "tbd", "todo", "no content", "no response", "empty", "blank", "placeholder", "lorem ipsum")
#: Apologies and the like that come before a refusal, and what may stand around it.
APOLOGY = (
    r"^(?:note |hinweis |remarque |nota )?((?:i'm |i am |we are |we're )?(?:very |so )?sorry(?: but| however)?|(?:my )?apologies(?: but)?|i apologi[sz]e(?: but)?|unfortunately|i'm afraid|as an? (?:ai |ai language |language )?(?:assistant|model)|thanks for asking(?: but| however)?"
    r"|(?:es )?tut mir leid(?: aber)?|leider(?: gilt)?|als assistent|entschuldigung|je suis désolée?(?: mais)?|désolée?(?: mais)?|malheureusement|en tant qu'assistant|lo siento(?: pero)?|lamentablemente|desafortunadamente|disculpe(?: pero)?|como asistente) "
)
NOTE = r"^(?:note|hinweis|remarque|nota) "
#: How somebody says that they don't answer.
DECLINE = (
    r"\b(?:i (?:can't|cannot|can not|could not|couldn't|won't|will not|must decline|decline)|i(?:'m| am) (?:not able|unable|not allowed)|i'd rather not|i would rather not|i don't have enough|ich (?:kann|darf|möchte) (?:\S+ ){0,4}(?:nicht|keine)|(?:kann|darf|möchte) ich (?:\S+ ){0,4}(?:nicht|keine)"
    r"|je ne (?:peux|suis|sais|souhaite)|je préfère ne pas|il m'est impossible|no puedo|no me es posible|prefiero no)\b"
)
#: The first sentence of a text.
HEAD = r"(?s)^.*?(?:[.!?。]+[\"'”»*_)]*(?=\s|$)|\n|$)"
INVISIBLE = "​‌‍⁠﻿­   "
QUOTED = r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"\n]*\""


def role_of(column: Column) -> Column:
    """user, assistant or system, however spelled; null for anything else."""
    role = F.lower(F.regexp_replace(column, r"[^\p{L}]", ""))
    spelled = F.when(role.isin("user", "human", "assistant", "system"), F.when(role == "human", "user").otherwise(role))
    return F.when(column.isin("user", "assistant", "system"), column).otherwise(spelled)


def pair_up(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", block: int = TURNS) -> DataFrame:
    """(conversation, turn, question, answer) of each assistant's message that follows a user's.

    - The message before is the one with the greatest earlier turn that is no system message; a reply
      after a reply makes no pair, and neither does a first message.
    - Repeated messages count once; of different messages with one turn, the one that sorts last counts as the question.
    - Messages with a null conversation or turn, or a role that is none of the three, are left out.
    - Null contents stay null. Other columns are dropped, so that their names can't clash.
    """
    rows = messages.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), role_of(F.col(role)).alias("role"), F.col(content).alias("content"))
    rows = rows.filter("conv is not null and turn is not null and role in ('user', 'assistant')").withColumn("block", F.floor(F.col("turn") / block))
    said = F.struct("turn", "role", F.when(F.col("role") == "user", F.col("content")).alias("content"))
    earlier = W.partitionBy("conv", "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    longest = rows.agg(F.max("turn")).first()[0]
    if longest is not None and longest >= block:
        rows = rows.unionByName(_carried(rows, said, block))
    paired = rows.withColumn("said", F.max(said).over(earlier))
    paired = paired.filter("role = 'assistant' and said.role = 'user' and turn >= block * " + str(block))
    return paired.select(F.col("conv").alias(conversation), F.col("turn").cast("int").alias(turn), F.col("said.content").alias("question"), F.col("content").alias("answer"))


def _carried(rows: DataFrame, said: Column, block: int) -> DataFrame:
    """The last message of each block of a long conversation, as what its next block begins with."""
    long = rows.filter(F.col("turn") >= block).select("conv").distinct()
    ends = rows.join(long, "conv", "left_semi").groupBy("conv", "block").agg(F.max(said).alias("carry"))
    later = W.partitionBy("conv").orderBy("block")
    ends = ends.select("conv", F.lead("block").over(later).alias("block"), "carry").filter("block is not null")
    return ends.select("conv", "carry.turn", F.col("carry.role").alias("role"), F.col("carry.content").alias("content"), "block")


def is_ascii(text: Column) -> Column:
    """As many bytes as characters."""
    return F.length(text) == F.octet_length(text)


def visible(text: Column) -> Column:
    """The text without invisible characters, trimmed; '' for null."""
    text = F.coalesce(text, F.lit(""))
    shown, hidden = text, F.lit(False)
    for char in INVISIBLE:  # plain search and replacement take a fraction of a regular expression's time
        shown, hidden = F.replace(shown, F.lit(char), F.lit(" ")), hidden | text.contains(char)
    return F.btrim(F.when(is_ascii(text) | ~hidden, text).otherwise(shown), F.lit(" \t\r\n\u000b\f\u3000"))


def plain_words(text: Column) -> Column:
    """Letters, numbers and inner apostrophes in lower case, one blank between words; markup left out.

    ``text`` is used many times, so it should be a column, not an expression.
    """
    bare = F.when(text.contains("<"), F.regexp_replace(text, r"<[^<>]*>", " ")).otherwise(text)
    lower = F.lower(bare)
    foldable = text.contains("’") | text.contains("ß") | text.contains("ẞ")
    folded = F.when(foldable, F.replace(F.replace(lower, F.lit("’"), F.lit("'")), F.lit("ß"), F.lit("ss"))).otherwise(lower)
    words = F.regexp_replace(folded, r"[^\p{L}\p{N}']+", " ")
    spaced = F.concat(F.lit(" "), words, F.lit(" "))
    inner = F.replace(F.replace(spaced, F.lit("' "), F.lit(" ")), F.lit(" '"), F.lit(" "))
    return F.btrim(F.when(text.contains("'") | text.contains("’"), inner).otherwise(words))


def is_empty(words: Column) -> Column:
    return (words == "") | words.isin(*PLACEHOLDERS)


def is_copy(question: Column, answer: Column) -> Column:
    """Both as plain words: nothing but the question, once or more, with up to four words of dress."""
    rest = F.btrim(F.regexp_replace(F.replace(answer, question, F.lit(" ")), " +", " "))
    dressed = (F.size(F.split(question, " ")) >= 3) & ((rest == "") | ((F.size(F.split(rest, " ")) <= 4) & ~rest.rlike("[0-9]")))
    return F.when((question == "") | ~answer.contains(question), False).when(answer == question, True).otherwise(dressed)


def with_language(rows: DataFrame, text: str, words: str, name: str) -> DataFrame:
    """Adds the language of a visible text by script and function words, quotations aside; null if it can't be told.

    ``words`` are the plain words of the text, which serve where nothing is quoted. Repeated words count once.
    """
    quoted = F.col(text).contains("“") | F.col(text).contains("«") | F.col(text).contains("„") | F.col(text).contains('"')
    bare = F.when(quoted, plain_words(F.regexp_replace(text, QUOTED, " "))).otherwise(F.col(words))
    every = sorted({w for known in WORDS.values() for w in known.split()})
    # the words of any language first: most words are of none, and are then out of the way
    rows = rows.withColumn("_words", F.array_distinct(F.filter(F.split(bare, " "), lambda w: w.isin(every))))

    def spoken(code: str) -> Column:
        known = WORDS[code].split()
        return F.size(F.filter("_words", lambda w: w.isin(known))).alias(f"_{code}")

    rows = rows.select("*", *[spoken(code) for code in WORDS])
    counts = {code: F.col(f"_{code}") for code in WORDS}
    most = F.greatest(*counts.values())
    own = F.regexp_replace(text, r"\[[^\]\n]*\]|https?://\S+", " ")
    script = lambda s: F.col(text).rlike(f"[{s}]") & (F.length(F.regexp_replace(own, f"[^{s}]", "")) * 2 > F.length(F.regexp_replace(own, r"[^\p{L}]", "")))
    # the language that is ahead of all others
    by_words = F.coalesce(*[F.when(n > F.greatest(*[other for c, other in counts.items() if c != code]), code) for code, n in counts.items()])
    told = F.when(most > 2, by_words).when(script(r"\u0400-\u04ff"), "ru").when(script(r"\u3040-\u30ff\u4e00-\u9fff"), "ja").otherwise(by_words)
    return rows.withColumn(name, told).drop("_words", *[f"_{code}" for code in WORDS])


def is_foreign(question: Column, answer: Column, asked: Column) -> Column:
    """Languages of both, and the question: another language that the question did not ask for."""
    wanted = F.lit(False)
    for code, pattern in ASKS.items():
        wanted = wanted | ((answer == code) & F.lower(asked).rlike(pattern))
    return answer.isNotNull() & question.isNotNull() & (answer != question) & ~wanted


def is_truncated(text: Column) -> Column:
    """Breaks off before its end: a visible text that ends neither a sentence nor a list, citation, link or code block.

    Complete without a final stop are short answers (a name, a number, a date, a reference) and lists whose
    last item is as short as an item, not a broken sentence. Three dots, an open bracket, quotation or code block, and
    a bare list marker at the end mean that the text breaks off.
    """
    tail = text
    fences = F.size(F.split(text, "```")) - 1
    closing = r"[\s\"'”’»“*_`)\]]*$"
    stopped = tail.rlike(r"[.!?。！？:]" + closing) & ~tail.rlike(r"(\.\.\.|…)" + closing) & ~tail.rlike(r":[\s*_]*$")
    # the last bracket tells whether any is never closed
    round_ = tail.contains("(") & (F.length(F.replace(tail, F.lit("("))) < F.length(F.replace(tail, F.lit(")"))))
    square = tail.contains("[") & ~F.substring_index(tail, "[", -1).contains("]")
    opened = round_ | square | (tail.contains("“") & tail.rlike(r"“[^”]*$") & ~tail.rlike(r"„[^“]*“[^”]*$"))
    cited = tail.rlike(r"\[[^\[\]]+\]\s*$") | tail.rlike(r"[.!?\p{L}\p{N}]\s*\([^()]*\)\s*$") | tail.rlike(r"(https?://|www\.)\S+$|\b\w[\w-]*(\.[\w-]+)+/\S*$")
    last = F.regexp_extract(tail, r"([^\n]*)$", 1)
    item = F.regexp_extract(last, r"^\s*(?:[-*•]|\d+[.)])\s+(\S.*)$", 1)
    sentence_list = text.rlike(r"\n\s*(?:[-*•]|\d+[.)])\s+[^\n]*[.!?]\s*\n") | text.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+[^\n]*[.!?]\s*\n")
    n_words = F.size(F.split(F.btrim(item), r"\s+"))
    whole_item = (item != "") & ~sentence_list & (n_words <= 6) & ~item.rlike(r"[,;:-]\s*$")
    short = F.size(F.split(F.btrim(text), r"\s+"))
    reference = r"^(?:pp?\.\s*[\d-]+|(?:section|page|abschnitt|seite|página|sección)\s+[\d.]+|(?:about|around|circa|ca\.|etwa|environ|unos)?\s*[\d.,]+\s*[%°\p{L}/]*|(?:\p{L}+ )?\p{Lu}?\p{L}+ \d{4}|\d+[./-]\d+[./-]\d+)$"
    name = r"^(?:\p{Lu}[\p{L}'.-]*|&|of|de|der|von|du)(?: (?:\p{Lu}[\p{L}'.-]*|&|of|de|der|von|du)){0,3}$"
    brief = (short <= 4) & (text.rlike("(?i)" + reference) | text.rlike(name)) & ~text.rlike(r"(?i)\b(?:of|de|der|von|du|&|in|the)$")
    # most answers end plainly or with a citation after a full stop; their last characters tell
    end, fenced = text, text.contains("```")
    plainly = F.substring(text, -2, 2).rlike(r"^[^.][.]$|[!?。]$") & ~F.substring(text, -8, 8).rlike(r"(?:^|\n) *\d+[.]$")
    cited_last = text.endswith("]") & end.rlike(r"[.!?。] ?\[[^\[\]]+\]$")
    cut = (fences % 2 == 1) | opened | tail.rlike(r"(\.\.\.|…)" + closing) | tail.rlike(r"\n\s*(?:[-*•]|\d+[.)])\s*$")
    return F.when((text == "") | (~fenced & (plainly | cited_last) & ~opened), False).otherwise(cut | ~(stopped | cited | tail.rlike(r"```\s*$") | whole_item | brief))


def opening_of(words: Column) -> tuple[Column, Column]:
    """Of the plain words of a first sentence: the first of them after an apology, and whether it apologizes or declines."""
    bare = F.regexp_replace(words, NOTE, "")
    core = F.regexp_replace(bare, APOLOGY, "")
    core = F.when(core != bare, F.regexp_replace(core, APOLOGY, "")).otherwise(core)
    return F.array_join(F.slice(F.split(core, " "), 1, OPENING), " "), (core != bare) | bare.rlike(DECLINE)


def cluster(openings: DataFrame, seed: str = "true") -> DataFrame:
    """(opening, label) of the distinct openings that are linked; the label is the smallest opening of the cluster.

    MinHash of the shingles (three letters, as an opening has few words) picks candidates, the share of common shingles
    verifies them. In each band an opening is compared with the band's smallest seed, never with all others; what is
    similar to it leaves the band, and the rest is parted by two more MinHashes and compared again, until no band has a seed and others. An
    opening that is similar to no seed gives no row; a seed that is similar to nothing is its own cluster. ``seed`` is a
    condition on ``openings``: links between two openings of which neither is one are not looked for.
    """

    def shingles(name: str) -> Column:
        padded = F.concat(F.lit(" "), F.col(name), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(padded, i, F.lit(SHINGLE)))))

    salts = random.Random(1)  # each makes another hash of a shingle

    def least(of: Column) -> Column:
        salt = salts.getrandbits(62)
        return F.array_min(F.transform(of, lambda s: F.xxhash64(s, F.lit(salt))))

    def comparable(bands: DataFrame) -> DataFrame:
        """Without the bands that have no seed, or nothing else."""
        return bands.join(bands.groupBy("band").agg(F.max("seed").alias("any"), F.count("*").alias("n")).filter("any and n > 1").select("band"), "band", "left_semi")

    # one row per shingle, so that hashes and minima are compiled code; the rows of an opening stay in its task
    rows = openings.groupBy("opening").agg(F.max(F.expr(seed)).alias("seed")).select("opening", "seed", F.explode(shingles("opening")).alias("shingle"))
    minima = [F.min(F.xxhash64("shingle", F.lit(salts.getrandbits(62)))).alias(f"_{i}") for i in range(BANDS * ROWS)]
    rows = rows.groupBy("opening").agg(F.max("seed").alias("seed"), *minima)
    bands = F.array(*[F.xxhash64(F.lit(b), *[f"_{b * ROWS + i}" for i in range(ROWS)]) for b in range(BANDS)])
    rows = materialize(rows.select("opening", "seed", F.explode(bands).alias("band")), "bands")
    left = comparable(rows)
    alike = (F.col("opening") == F.col("rep")) | (F.size(F.array_intersect(shingles("opening"), shingles("rep"))) >= SIMILAR * F.size(F.array_union(shingles("opening"), shingles("rep"))))
    links = rows.filter("seed").select("opening", F.col("opening").alias("label")).distinct()
    while not left.isEmpty():
        reps = left.filter("seed").groupBy("band").agg(F.min("opening").alias("rep"))
        judged = materialize(left.join(reps, "band").withColumn("alike", alike), "judged-bands")
        links = links.unionByName(judged.filter("alike").select("opening", F.col("rep").alias("label")))
        left = comparable(judged.filter("not alike").select("opening", "seed", F.xxhash64("band", *[least(shingles("opening")) for _ in range(2)]).alias("band")))
    links = materialize(links.distinct(), "links")
    label = links.groupBy("opening").agg(F.min("label").alias("label"))
    ends = links.filter("opening != label").select("opening", F.col("label").alias("other"))
    ends = ends.unionByName(ends.select(F.col("other").alias("opening"), F.col("opening").alias("other")))
    while True:  # both ends of a link take the smaller label, until none changes
        around = ends.join(label.select(F.col("opening").alias("other"), F.col("label").alias("around")), "other").groupBy("opening").agg(F.min("around").alias("around"))
        new = materialize(label.join(around, "opening", "left").select("opening", F.least("label", "around").alias("label"), (F.col("around") < F.col("label")).alias("moved")), "labels")
        label = new.select("opening", "label")
        if new.filter("moved").isEmpty():
            return label


def refusal_openings(candidates: DataFrame) -> DataFrame:
    """The openings that refuse, of rows (opening, declines, topic, rest, figures): recurring, declining, and informing of nothing.

    topic is the question, rest a hash of what follows the first sentence, figures one of the numbers in it that the question
    doesn't name; null where there is none. What recurs is counted by sketches, exact for the few that matter.
    """
    def ways(column: str) -> Column:
        return F.hll_sketch_agg(column).alias(column)

    seen = candidates.groupBy("opening").agg(F.count("*").alias("n"), F.sum(F.col("declines").cast("int")).alias("declines"), F.count("rest").alias("rests"), F.count("figures").alias("figured"), ways("topic"), ways("rest"), ways("figures"))
    seen = materialize(seen, "openings")
    labels = cluster(seen, "declines > 0")

    def united(column: str) -> Column:
        return F.hll_sketch_estimate(F.hll_union_agg(column)).alias(column)

    rows = seen.join(labels, "opening").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("n", "declines", "rests", "figured")], united("topic"), united("rest"), united("figures"))
    own_rest = (F.col("rests") * 2 >= F.col("n")) & (F.col("rest") > WAYS) & (F.col("rest") * 2 >= F.col("rests"))
    own_figures = (F.col("figured") * 2 >= F.col("n")) & (F.col("figures") > 1)
    chosen = rows.filter((F.col("topic") >= RECURS) & (F.col("declines") >= DECLINES * F.col("n")) & ~own_rest & ~own_figures)
    return labels.join(chosen.select("label"), "label", "left_semi").select("opening")


def judge(pairs: DataFrame) -> DataFrame:
    """Of each pair the defect that it shows by itself, and what tells refusals: opening, declines, topic, rest, figures.

    Whatever is used more than once is a column first: an expression inside a condition and its value would be computed for each.
    """
    pairs = pairs.withColumn("a", visible(F.col("answer"))).withColumn("q", F.coalesce("question", F.lit("")))
    pairs = pairs.withColumn("aw", plain_words(F.col("a"))).withColumn("qw", plain_words(F.col("q")))
    pairs = with_language(with_language(pairs, "q", "qw", "ql"), "a", "aw", "al")
    # the first sentence, or the whole answer where that is too short to be one, and what follows it
    pairs = pairs.withColumn("first", F.regexp_extract("a", HEAD, 0))
    pairs = pairs.withColumn("head", plain_words(F.col("first"))).withColumn("brief", F.size(F.split("head", " ")) < BRIEF)
    rest = F.when(~F.col("brief"), F.btrim(F.regexp_replace(F.lower(F.substring("a", F.length("first") + 1, F.length("a"))), r"[^\p{L}]+", " ")))
    head = F.when(F.col("brief"), F.col("aw")).otherwise(F.col("head"))
    pairs = pairs.withColumn("rest", rest).withColumn("head", head)
    numbers = F.array_except(F.filter(F.split("head", " "), lambda w: w.rlike("[0-9]")), F.split("qw", " "))
    pairs = pairs.withColumn("figures", F.when(~F.col("head").rlike("[0-9]"), "").otherwise(F.array_join(numbers, " ")))
    opening, declines = opening_of(F.col("head"))
    plain = (
        F.when(is_empty(F.col("aw")), "empty")
        .when(is_copy(F.col("qw"), F.col("aw")), "copy")
        .when(is_foreign(F.col("ql"), F.col("al"), F.col("q")), "language")
        .when(is_truncated(F.col("a")), "truncated")
    )
    return pairs.select(
        "conv_id", "turn", plain.alias("defect"), opening.alias("opening"), declines.alias("declines"), F.xxhash64("qw").alias("topic"),
        F.when(F.col("rest") != "", F.xxhash64("rest")).alias("rest"), F.when(F.col("figures") != "", F.xxhash64("figures")).alias("figures"),
    )


def defects(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, defect) of each defective pair; at most one defect, in the order empty, copy, refusal, language, truncated.

    Texts are judged whole, and no answer is left out by its length or its numbers. An empty table gives an empty result; see ``pair_up`` for nulls, ties and repeated rows.
    """
    # written before anything is filtered by what was computed: a filter pushed down would compute it all again
    judged = materialize(judge(pair_up(messages)), "judged").filter("defect is not null or opening is not null").dropDuplicates(["conv_id", "turn"])
    unsure = judged.filter("opening != '' and (defect is null or defect not in ('empty', 'copy'))")
    brief = F.array_join(F.slice(F.split("opening", " "), 1, BRIEF), " ")
    unsure = unsure.select("conv_id", "turn", "declines", "topic", "rest", "figures", F.explode(F.array_distinct(F.array("opening", brief))).alias("opening"))
    refused = unsure.join(refusal_openings(unsure), "opening", "left_semi").select("conv_id", "turn", F.lit("refusal").alias("refusal"))
    known = judged.filter("defect is not null").select("conv_id", "turn", "defect", F.lit(None).cast("string").alias("refusal"))
    both = known.unionByName(refused, allowMissingColumns=True).groupBy("conv_id", "turn").agg(F.max("defect").alias("defect"), F.max("refusal").alias("refusal"))
    return both.select("conv_id", "turn", F.coalesce("refusal", "defect").alias("defect"))
