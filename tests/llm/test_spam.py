from sparkgrove.llm import spam as s

PROSE = "The pump was replaced in June because the seal had worn out. It took nine days to confirm that the valve was not affected."
KEYWORDS = "pump seal, pump seal cheap, buy pump seal online, pump seal, valve, pump seal sale, valve, pump seal, best price, pump seal, valve"
SEO = "Looking for a pump seal? Our pump seal is the valve you need for every pump seal. Buy pump seal here: valve offers, pump seal prices and pump seal reviews. Why valve? Because pump seal and valve go with pump seal!"
MENU = "Home » Login » Pump Seal » Cart » Next page\nContact » Imprint » Home » Sitemap » Login"
LINKS = "* Pump Seal: https://a.test/pump\n* Valve: https://b.test/valve/x\n[seal](https://c.test/y)\nwww.d.test/z"
TAGS = "<tag>pump seal</tag> tag:valve <tag>filter</tag> tag:pump_seal\n#PumpSeal #Valve #Filter #Valve"
ROWS = "\n".join(f"202{i}-05-13 pump; 4.{i} hours; checked by shift A" for i in range(8))
GLOSSARY = "Pump: The pump moves the water from the tank to the plant.\nSeal: The seal keeps the water in the pump.\nValve: A valve stops the flow where it is not wanted."
SUBJECT = "The pump seal was approved in June after the pump seal reached its limit. We recommend that the plant replaces the pump seal before winter. During the visit, the team found that the pump seal had been audited twice."
UNIQUE = ", ".join(f"{a}{b}or {b}{a}it" for a in ("zu", "ke", "mo", "ra", "bi") for b in ("la", "fe", "go"))
SCHEMA = "doc_id long, text string, source string"


def pages(spark, texts, hosts=3):
    return spark.createDataFrame([(i, t, f"h{i % hosts}") for i, t in enumerate(texts)], SCHEMA)


def test_lists_are_told_from_text(spark):
    lists = [KEYWORDS, MENU, LINKS, TAGS, "\n".join(KEYWORDS.split(", ")), "pump seal (12) | valve (4) | filter (77) | pump seal (9)", UNIQUE, SEO, KEYWORDS.replace("e", "​e").replace("a", "а")]
    texts = [PROSE, GLOSSARY, SUBJECT, "Scope\n" + PROSE, "Договор был продлён на 3 месяцев без изменения условий.", "保守費用は前年と比べて226.3パーセント増加しました。", PROSE * 3 + "\nReferences: " + KEYWORDS]
    found = {r.doc_id: r for r in s.spam_pages(pages(spark, [*lists, *texts])).collect()}
    assert all(found[i].list_share > 0.5 for i in range(len(lists)))
    assert all(found[len(lists) + i].list_share < 0.5 for i in range(len(texts)))
    # stuffed sentences are told by the phrases they repeat, not by their function words
    assert found[lists.index(SEO)].plain_list_share < 0.5


def test_pages(spark):
    docs = [(i, t, "h%d" % (i % 3)) for i, t in enumerate([KEYWORDS, PROSE, SEO, MENU, ROWS, KEYWORDS, None, "", " \n ", PROSE * 4000, LINKS, TAGS, LINKS, MENU])]
    rows = spark.createDataFrame([*docs, (50, KEYWORDS, None), (None, KEYWORDS, "h1")], SCHEMA)
    found = {r.doc_id: r.spam for r in s.spam_pages(rows.union(rows).selectExpr("*", "1 as key", "2 as host", "3 as phrase")).collect()}
    assert {i for i, x in found.items() if x} == {0, 2, 3, 5, 10, 11, 12, 13, 50}
    assert not {6, 7, 8} & found.keys()
    assert s.spam_pages(rows.limit(0)).count() == 0


def test_a_list_is_spam_only_if_its_phrases_stand_elsewhere(spark):
    alone = {r.doc_id: r for r in s.spam_pages(pages(spark, [UNIQUE, PROSE])).collect()}
    assert alone[0].list_share > 0.5 and alone[0].stitched_share == 0 and not alone[0].spam
    assert {r.doc_id for r in s.spam_pages(pages(spark, [UNIQUE, PROSE, PROSE, UNIQUE + "."], hosts=2)).collect() if r.spam} == {0, 3}
    # copies under one host prove nothing
    assert not [r for r in s.spam_pages(pages(spark, [UNIQUE, PROSE, UNIQUE + "."], hosts=1)).collect() if r.spam]


def test_copies_under_many_hosts_are_not_spam_by_that(spark):
    rows = spark.createDataFrame([(i, PROSE, f"h{i}") for i in range(20)], SCHEMA)
    found = s.spam_pages(rows).collect()
    assert len(found) == 20 and not any(r.spam for r in found)
