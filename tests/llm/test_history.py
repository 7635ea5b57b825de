import random

from sparkgrove.llm import history as h

SCHEMA = "entry_id long, batch_no int, file_hash string, source_path string, filename string"


def run(spark, rows):
    return {(r.entry_id_a, r.entry_id_b) for r in h.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_names_and_places():
    assert h.name_words("Copy of Divvidend%20Manual-Part_05 (2).PDF.pdf") == ["divvidend", "manual", "part", "5"]
    assert h.name_words("übersicht - Kopie.pdf") == h.name_words("UBERSICHT.pdf") == ["ubersicht"]
    assert h.name_words(None) == h.name_words(" .pdf") == []
    same = ["/mnt/share/Finance/x/drafts 2023/a.pdf", "Z:\\finance\\x\\drafts_2023\\a.pdf", "smb://filer.test/share/finance/./x//drafts%202023/a.pdf", "file:///data/incoming/finance/x/tmp/../drafts-2023/a.pdf", "\\\\filer.test\\share\\FINANCE\\x\\drafts 2023\\a.pdf"]
    assert len({h.place_of(p) for p in same}) == 1
    assert h.place_of("/mnt/share/finance/y/drafts 2023/a.pdf") != h.place_of(same[0])
    assert h.place_of(None) is h.place_of("") is h.place_of("a.pdf") is None


def test_hashes_however_written(spark):
    x = "ab" * 16
    rows = [(v, x) for v in (x, x.upper(), f"md5:{x}", f"MD5={x}", f"md5 {x}", f"0x{x}", f'"{x}"', f" {x}\n")] + [(v, None) for v in (None, "", "n/a", "unknown", "0" * 32, "d41d8cd98f00b204e9800998ecf8427e", x[1:])]
    from pyspark.sql import functions as F

    found = spark.createDataFrame(rows, "v string, want string").select(h.hash_key(F.col("v")), "want").collect()
    assert all(r[0] == r[1] for r in found)


def test_entries_are_judged_in_order(spark):
    place = "/mnt/share/legal/x/out/"
    x, y = "a" * 31 + "1", "b" * 31 + "2"
    rows = [
        (1, 0, x, place + "alpha report 2020.pdf", "alpha report 2020.pdf"),
        (2, 1, None, "/srv/docs/legal/x/out/alhpa report 2020.pdf", "alhpa report 2020.pdf"),  # a slip
        (3, 1, None, place + "alpha report 2021.pdf", "alpha report 2021.pdf"),  # another number: accepted
        (4, 1, y, place + "alpha report 2020 (1).pdf", "alpha report 2020 (1).pdf"),  # repeats 1, so its hash is not accepted
        (5, 2, y, "/home/desk/5/scan.pdf", "scan.pdf"),  # accepted: only a rejected entry had this hash
        (6, 2, y, None, "other.pdf"),  # repeats 5, in the same batch
        (7, 2, "unknown", None, "other.pdf"),  # nothing known
        (8, 3, f"md5:{x.upper()}", None, None),
        (9, 3, None, place + "alpha summary 2020.pdf", "alpha summary 2020.pdf"),  # another word
        (10, 3, None, "/mnt/share/legal/z/out/alpha report 2020.pdf", "alpha report 2020.pdf"),  # another directory
    ]
    assert run(spark, rows + rows[3:5]) == {(1, 2), (1, 4), (5, 6), (1, 8)}


def brute(rows):
    keys = [(e, b, (f if f and len(set(f)) > 1 else None), h.place_of(p), h.name_words(n)) for e, b, f, p, n in sorted(rows)]
    accepted, found = [], set()

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    def same(a, b):
        if len(a) != len(b):
            return False
        slips = 0
        for x, y in zip(a, b):
            if x != y:
                short = min(len(x), len(y))
                e = edits(x, y)
                if any(map(str.isdigit, x + y)) or short < 4 or not (e <= 1 or e == 2 and (short >= 6 or sorted(x) == sorted(y))):
                    return False
                slips += 1
        return slips <= h.SLIPS

    for e, b, f, p, n in keys:
        hits = [x[0] for x in accepted if (f and x[2] == f) or (p and n and x[3] == p and same(n, x[4]))]
        if b and hits:
            found.add((min(hits), e))
        else:
            accepted.append((e, b, f, p, n))
    return found


def test_equals_brute_force(spark):
    rnd = random.Random(11)
    words = ["budget", "report", "summary", "pallet", "survey", "humidity"]
    rows = []
    for e in range(1, 160):
        name = [rnd.choice(words) for _ in range(rnd.randint(1, 4))] + ([str(rnd.randint(1, 3))] if rnd.random() < 0.6 else [])
        if rnd.random() < 0.3:
            k = rnd.randrange(len(name))
            at = rnd.randrange(len(name[k]))
            name[k] = name[k] if name[k].isdigit() else name[k][:at] + name[k][at] + name[k][at:]
        file = rnd.choice(["-", " ", "_"]).join(name) + ".pdf"
        place = f"{rnd.choice(['/mnt/share', '/srv/docs', 'Z:'])}/legal/{rnd.choice('xy')}/out/"
        rows.append((e, 0 if e < 40 else 1 + e // 60, rnd.choice([None, f"{rnd.randint(1, 60):032x}", "0" * 32]), rnd.choice([None, place + file, place + file]), file))
    assert run(spark, rows) == brute(rows)


def test_pieces_find_every_slip():
    rnd = random.Random(3)
    for _ in range(3000):
        word = "".join(rnd.choice("abcde") for _ in range(rnd.randint(4, 9)))
        other = list(word)
        for _ in range(rnd.randint(0, h.SLIPS)):
            at = rnd.randrange(len(other))
            kind = rnd.randrange(3)
            other[at : at + (kind != 0)] = [rnd.choice("abcde")] if kind != 2 else []
        other = "".join(other)
        if len(other) >= h.LEAST:
            assert set(h.piece_tokens(word)) & set(h.piece_probes(other)), (word, other)


def test_short_names_of_one_directory_share_no_token(spark):
    rnd = random.Random(5)
    names = {"".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(9)) for _ in range(400)}
    rows = [(i, 0, None, f"/mnt/share/x/{n}.pdf", f"{n}.pdf") for i, n in enumerate(sorted(names))]
    index = h.HistoryIndex.create(h.canonical(spark.createDataFrame(rows, SCHEMA)))
    most = spark.read.parquet(f"{index.path}/postings").groupBy("token").count().agg({"count": "max"}).first()[0]
    assert most < 20


def test_a_later_session_goes_on_without_the_history(spark, tmp_path):
    place = "/mnt/share/legal/x/out/"
    rows = [(i, 0 if i < 20 else 1 if i < 40 else 2, f"{i % 25:032x}" if i % 25 > 1 else None, place + f"report alpha {i % 30}.pdf", f"report alpha {i % 30}.pdf") for i in range(60)]
    keyed = h.canonical(spark.createDataFrame(rows, SCHEMA))
    h.HistoryIndex.create(keyed.filter("batch_no = 0"), path=f"{tmp_path}/index", buckets=7)
    found = set()
    for number in (1, 2):
        index = h.HistoryIndex.open(spark, f"{tmp_path}/index")
        assert index.buckets == 7 and len(index.commits) == number
        found |= {(r.accepted_id, r.entry_id) for r in index.judge(keyed.filter(f"batch_no = {number}")).collect()}
    assert found == run(spark, rows) == brute(rows)
    # postings of an append that was cut short are not read
    index = h.HistoryIndex.open(spark, f"{tmp_path}/index")
    index.spark.read.parquet(f"{index.path}/postings").filter(f"commit = '{index.commits[0]}'").drop("commit", "bucket").write.parquet(f"{index.path}/postings/commit=x/bucket=0")
    assert index.judge(keyed.filter("batch_no = 2")).count() == 20


def test_mounts_are_a_parameter(spark):
    assert h.place_of("/mnt/archive/a/x.pdf") != h.place_of("/a/x.pdf")
    assert h.place_of("/mnt/archive/a/x.pdf", (r"/mnt/archive/",)) == h.place_of("/a/x.pdf")


def test_empty_tables(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, 0, "a" * 31 + "1", None, None)]) == set()
    assert run(spark, [(1, 1, "a" * 31 + "1", None, None), (2, 1, "a" * 31 + "1", "", "")]) == {(1, 2)}
