import random

import pytest

from sparkgrove.llm import pairs as p
from tests.sqlcheck import check, connect  # noqa: F401

SCHEMA = "conv_id long, turn int, role string, content string"
REFUSALS = ["I am not able to answer this question.", "Sorry, I am not able to answer this question.", "Unfortunately, I am not able to answer this question at this time."]


def chats(spark, talks):
    rows = [(i, t, role, text) for i, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    return spark.createDataFrame(rows, SCHEMA)


def judged(spark, cases):
    talks = [[("user", q), ("assistant", a)] for q, a in cases]
    return {r.conv_id: r.defect for r in p.defects(chats(spark, talks)).collect()}


def test_pairs_skip_system_messages_and_replies_to_replies(spark):
    rows = chats(spark, [[("User", "q1"), ("system", "s"), ("ASSISTANT ", "a1"), ("assistant", "a2"), ("user", None), (" assistant", "a3")], [("assistant", "first")], [("user", "q"), ("user", "r"), ("assistant\n", None)]])
    found = {(r.conv_id, r.turn, r.question, r.answer) for r in p.pair_up(rows.union(rows)).collect()}
    assert found == {(0, 2, "q1", "a1"), (0, 5, None, "a3"), (2, 2, "r", None)}


def test_long_conversations_are_cut_into_blocks(spark):
    talk = [("user" if i % 3 == 0 else "assistant" if i % 3 == 1 else "system", str(i)) for i in range(200)]
    talk[32:60] = [("system", "s")] * 28
    rows = chats(spark, [talk, talk[:5]])
    whole = {tuple(r) for r in p.pair_up(rows).collect()}
    for block in (1, 7, 16):
        assert {tuple(r) for r in p.pair_up(rows, block=block).collect()} == whole


def test_defects_and_what_is_none(spark):
    q = "How many heat exchanger cases remain open?"
    cases = [
        (q, None, "empty"), (q, "", "empty"), (q, " \u200b\n", "empty"), (q, "<p></p>", "empty"), (q, "N/A", "empty"), (q, "```\n```", "empty"), (q, "None.", None), (q, "Yes.", None),
        (q, q, "copy"), (q, "You asked: " + q, "copy"), (q, "**" + q.upper() + "**", "copy"), (q, q + " " + q, "copy"), (q, q + " Nine cases remain open at the plant today.", None),
        (q, "The report says that nine cases remain", "truncated"), (q, "The first case was closed. The second ca...", "truncated"), (q, "The figures are:\n```\nlimit: 4\n```", None), (q, "The figures are:\n```\nlimit: 4", "truncated"),
        (q, "The open points are:\n- pump\n- valve (minor)", None), (q, "1. The pump was replaced.\n2. The valve is new.\n3.", "truncated"), (q, "pp.4-11", None), (q, "Section 5", None), (q, "Zobizo & Co", None), (q, "June 2014", None),
        (q, "The pump was replaced in June. [a.pdf → Scope, pp.4-9]", None), (q, "The pump was replaced in June. [a.pdf → Scope, pp.", "truncated"),
        (q, "Es bleibt offen, ob die Dichtung noch in diesem Jahr ersetzt werden kann.", "language"), ("Answer in German, please. " + q, "Es bleibt offen, ob die Dichtung noch in diesem Jahr ersetzt werden kann.", None),
        (q, "The title of the report is “der Wartungsplan” and it was not replaced.", None), (q, "Все образцы хранились в холодильной камере.", "language"), ("Was sagt der Bericht über die Kosten?", "Ja, siehe Seite 4.", None),
        (q, "Unfortunately the pump failed its test in May 2018, so it was replaced.", None), ("", "", "empty"), (None, "A whole answer.", None),
    ]
    found = judged(spark, [(a, b) for a, b, _ in cases])
    for i, (_, answer, want) in enumerate(cases):
        assert found.get(i) == want, answer


def test_refusals_are_templates_that_recur_under_unrelated_questions(spark):
    cases = [(f"What about the pump number {i}?", REFUSALS[i % 3]) for i in range(9)] + [(f"What about the valve number {i}?", "You are welcome to read all of it.") for i in range(9)]
    cases += [("What is open?", "Sorry, this one answer came only once.")]
    found = judged(spark, cases)
    assert {i for i, d in found.items() if d == "refusal"} == set(range(9))
    assert 9 not in found and 18 not in found


ASKED = ["How many pumps are open?", "Who signed the lease?", "When was the valve replaced?", "Why did the audit fail?", "Which pages cover the seal?", "Is there a deadline for the tax return?"]


def test_refusals_of_six_questions(spark):
    sets = [
        ["I'm sorry, but I can't help with that request."] * 6,  # control
        ["I am unable to discuss such matters here."] * 6,  # without apology
        ["I'm sorry, but this must stay open. Please ask again within 24 hours."] * 6,  # a number
        ["Unfortunately, nothing lets me settle request 7."] * 6,
        ["Apologies, you must look that up. " + "Please contact the owner of the document for more. " * 12] * 6,  # long
        ["That topic is off limits for me.", "Sorry, that topic is off limits for me."] * 3,  # with and without
        ["I'd rather not speculate about any of this.", "Id rather not speculate about any of this.", "I'd rather not speculatte about any of this."] * 2,  # spelled otherwise
    ]
    cases = [(q, a) for answers in sets for q, a in zip(ASKED, answers)]
    assert judged(spark, cases) == {i: "refusal" for i in range(len(cases))}


def test_what_is_no_refusal(spark):
    cases = [(q, "I'm sorry, but I can't help with that request.") for q in ASKED[:2]]  # under two questions only
    cases += [(q, f"Unfortunately the pump failed its test in May {2010 + i}, so it was replaced.") for i, q in enumerate(ASKED)]  # figures of their own
    cases += [(q, f"Sorry for the delay. The report of {q[:7]} number {'abcdefghi'[i % 6]} names {'klmnopqr'[i // 6]} as the plant.") for i, q in enumerate(ASKED * 3)]  # go on differently
    cases += [(q, "No, it was repaired earlier.") for q in ASKED]  # neither apologizes nor declines
    assert judged(spark, cases) == {}


def test_clusters_are_verified(spark):
    rows = [("i am not able to answer",), ("i am not able to anwser",), ("i am not able to answr",), ("one two three four five six",), ("one two three four five seven",), ("one two three four five six",), ("short",), ("",)]
    labels = {r.opening: r.label for r in p.cluster(spark.createDataFrame(rows, "opening string")).collect()}
    assert labels == {x[0]: "i am not able to answer" if x[0] == "i am not able to answr" else x[0] for x in rows} | {k: labels[k] for k in labels if k.startswith(("i am not able to an", "one two"))}
    assert labels["i am not able to answer"] == labels["i am not able to answr"] != labels["short"]


def test_clusters_equal_brute_force(spark):
    rnd = random.Random(4)
    openings = set()
    for i in range(40):
        base = " ".join(rnd.choice(["able", "answer", "cannot", "discuss", "request", "topic", "limits", "document"]) for _ in range(6))
        for _ in range(6):
            at = rnd.randrange(len(base))
            openings.add(base[:at] + base[at + rnd.randint(0, 1) :])
    grams = {o: {f" {o} "[i : i + 3] for i in range(len(o))} for o in openings}
    label = {o: o for o in openings}
    for _ in range(len(openings)):
        new = {o: min(label[x] for x in openings if len(grams[o] & grams[x]) >= 0.8 * len(grams[o] | grams[x])) for o in openings}
        if new == label:
            break
        label = new
    found = {r.opening: r.label for r in p.cluster(spark.createDataFrame([(o,) for o in openings], "opening string")).collect()}
    same = sum(found[o] == label[o] for o in openings)
    assert found.keys() == openings
    assert same >= 0.9 * len(openings), same / len(openings)


def test_long_texts_and_empty_table(spark):
    text = "The pump was replaced and the valve was not. " * 20_000
    assert judged(spark, [("Was the pump replaced?", text), ("Was the pump replaced?", text + "And the")]) == {1: "truncated"}
    assert p.defects(spark.createDataFrame([], SCHEMA + ", block int, said string")).count() == 0


@pytest.mark.parametrize("column", ["role", "content", "turn", "conv_id"])
def test_nulls_in_any_column(spark, column):
    rows = chats(spark, [[("user", "What is open at the plant?"), ("assistant", "")]])
    none = rows.selectExpr(*[f"cast(null as {t}) as {c}" if c == column else c for c, t in rows.dtypes])
    assert p.defects(none).count() == (1 if column == "content" else 0)


def test_no_text_is_searched_twice_for_one_value(spark, monkeypatch):
    class Caught(Exception):
        pass

    def catch(rows, name):
        raise Caught(rows)

    monkeypatch.setattr(p, "materialize", catch)
    with pytest.raises(Caught) as caught:
        p.defects(chats(spark, [[("user", "What is open?"), ("assistant", "The pump. The valve too.")]]))
    plan = caught.value.args[0]._jdf.queryExecution().optimizedPlan().toString()
    # the first sentence, and what follows it without numbers
    assert plan.count(p.HEAD) == 1
    assert plan.count(r", [^\p{L}]+, ") == 1


def test_shortcuts_equal_the_whole_expressions(spark):
    rnd = random.Random(5)
    bits = ["the", "It’s", "Straße", "ẞ", "don't", "'", "’ ", "(", ")", "[", "]", "“", "”", "„", "<b>", ".", "…", "\n", " ", "1", "é", "İ", *p.INVISIBLE]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    t = p.F.col("text")
    folded = p.F.regexp_replace(p.F.regexp_replace(p.F.lower(p.F.regexp_replace(t, r"<[^<>]*>", " ")), "’", "'"), "ß", "ss")
    spaced = p.F.concat(p.F.lit(" "), p.F.regexp_replace(folded, r"[^\p{L}\p{N}']+", " "), p.F.lit(" "))
    words = p.F.btrim(p.F.replace(p.F.replace(spaced, p.F.lit("' "), p.F.lit(" ")), p.F.lit(" '"), p.F.lit(" ")))
    seen = p.F.btrim(p.F.regexp_replace(t, f"[{p.INVISIBLE}]", " "), p.F.lit(" \t\r\n\u000b\f　"))
    assert rows.filter((p.visible(t) != seen) | (p.plain_words(t) != words)).collect() == []
    roles = spark.createDataFrame([(r,) for r in ("user", "User ", "human", "assistant", "system", "tool", None)], "role string").select(p.role_of(p.F.col("role")))
    assert [r[0] for r in roles.collect()] == ["user", "user", "user", "assistant", "system", None, None]
