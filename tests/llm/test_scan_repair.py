import random
import numpy as np

from leafstack.llm import scan_repair as S


def test_fold_and_distance():
    for true, read in (("committee", "cornmittee"), ("panel", "pariel"), ("deliveries", "del|veries"), ("returns", "retiirns"), ("background", "backgroiind"), ("resilient", "resihent"), ("modern", "modem")):
        assert S.fold(true) == S.fold(read) and S.distance(true, read) <= 1.2, read
    assert S.distance("cat", "dog") > 2


def test_page_numbers():
    for line, page in (("2", 2), ("— 1 —", 1), ("3/4", 3), ("p. 4", 4), ("[ 1 ]", 1), ("Page l", 1), ("Seite 4 von 4", 4), ("iii", 3), ("- 4 -", 4), ("Página 3 de 8", 3)):
        assert S.page_number_line(line, page), line
    for line, page in (("2022.", 8), ("- 152", 7), ("17", 3), ("V.", 5), ("- Item 4", 4), ("In 2004", 4), ("", 1)):
        assert not S.page_number_line(line, page), line


def test_headers():
    assert S.formed_head(["Umdawick / V9-970X", "", "The text goes on."], 0)
    assert S.formed_head(["DUNDUVIK C0NTRACT FOR RENT", "", "The text"], 0)
    assert not S.formed_head(["The b2b portal in Wesmaven logged 645 m3 and the file", "a4v.pdf for rent."], 0)
    assert not S.plausible_head("- Audit in Marlond") and not S.plausible_head("[Sheet: Q2]")


def test_breaks():
    m = lambda s: S.BREAK.search(s)
    assert S.breaks(m("pro- \ngramme"), {"programme": 4}) and S.breaks(m("emis­\nsions"), {})
    assert not S.breaks(m("short-\nand"), {}) and not S.breaks(m("courier-\ncosts"), {"courier-costs": 5})
    assert S.breaks(m("thous-\nand"), {"thousand": 9})


def test_words_leave_out_codes():
    words = [w for _, _, w in S.text_words("The K50-781A unit, file a4v53.7b.pdf and c0sts pro-\ngramme sвЂ™en (12)")]
    assert "c0sts" in words and "The" in words and not any(w in words for w in ("a4v53.7b.pdf", "K50", "pro", "gramme"))


def chunks(spark):
    clean = "The committee reviewed the annual forecast. Deliveries took nine days on average. The cost of travel was noted."
    rows = [(d, 0, 1, None, clean) for d in range(30)]
    rows += [(100, 0, 1, None, "Tarlix / K1-2X\n\nThe cornmittee reviewed the annua1 fore-\ncast. Deliveries took nine days\non average.\n\n- 1 -"), (100, 1, 2, None, "Tarlix / K1-2X\n\nThe cost of travel was noted."), (100, 1, 2, None, "Tarlix / K1-2X\n\nThe cost of travel was noted."), (101, 0, 1, None, None), (101, 1, 2, None, ""), (102, 0, None, "Q2", "[Sheet: Q2]\n1 | 2"), (None, 0, 1, None, "x"), (103, 0, 1, None, "word " * 40000)]
    return spark.createDataFrame(rows, "doc_id long, chunk_index int, page_no int, sheet_name string, text string").selectExpr("*", "'k' AS lexicon", "1 AS page")


def test_repair(spark):
    got = {(r["doc_id"], r["chunk_index"]): r for r in S.repair_pages(chunks(spark)).collect()}
    assert len(got) == 30 + 2 + 2 + 1 + 1
    assert {k for k, r in got.items() if r["noisy"]} == {(100, 0), (100, 1)}
    first = got[100, 0]
    assert (first["hyphens"], first["misread"], first["headers"], first["numbers"]) == (1, 2, 1, 1)
    assert first["repaired"] == "The committee reviewed the annual forecast. Deliveries took nine days on average."
    assert got[101, 0]["repaired"] is None and got[101, 1]["repaired"] == "" and got[102, 0]["repaired"].startswith("[Sheet: Q2]")


def test_empty_table(spark):
    assert S.repair_pages(chunks(spark).limit(0)).count() == 0


def test_context_picks():
    pairs = np.zeros(S.PAIR_CELLS, np.int32)
    pairs[S.pair_cell("the", "cost")] = 50
    options = {"co5t": [{"printed": "cost", "score": 1.0}, {"printed": "cast", "score": 1.2}]}
    assert S.repair_page("the co5t", 1, False, set(), {}, options, pairs)[-1] == "the cost"


def test_copies_of_a_noisy_page_do_not_vouch(spark):
    rows = [(d, 0, 1, None, f"The committee met in room {d}. The committee agreed.") for d in range(20)] + [(100 + d, 0, 1, None, "The cornmittee was late.") for d in range(15)]
    got = S.repair_pages(spark.createDataFrame(rows, "doc_id long, chunk_index int, page_no int, sheet_name string, text string")).where("noisy").collect()
    assert {r["doc_id"] for r in got} == set(range(100, 115)) and {r["repaired"] for r in got} == {"The committee was late."}


def test_context_may_pick_the_fourth_candidate(spark):
    texts = [f"We {w} seen." for w, n in (("bally", 9), ("baily", 8), ("baiiy", 7)) for _ in range(n)] + ["A red baliy came."] * 6 + ["A red ba11y came."]
    rows = [(d, 0, 1, None, t) for d, t in enumerate(texts)]
    got = S.repair_pages(spark.createDataFrame(rows, "doc_id long, chunk_index int, page_no int, sheet_name string, text string"))
    assert got.where(f"doc_id = {len(rows) - 1}").first()["repaired"] == "A red baliy came."


def test_neighbour_counts_of_a_full_task(spark):
    letters = "abcdefghjkmnopqrstuvwxyz"
    many = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters)
    _, pairs = S.count_words(spark.createDataFrame([(many,)], "text string"))
    assert pairs.sum() == len(many.split())


def test_letterhead_of_many_documents(spark):
    """A header that a third of all documents carry is found; a heading that stands once in each is left."""
    page = lambda d, c: ("Halvik Trading Company Ltd\n\n" if d % 3 == 0 else "Overview\n\n" if c == d % 3 else "") + f"The room {d} was seen on day {c}. It was closed after {c} hours."
    rows = [(d, c, c + 1, None, page(d, c)) for d in range(60) for c in range(3)]
    got = S.repair_pages(spark.createDataFrame(rows, "doc_id long, chunk_index int, page_no int, sheet_name string, text string")).where("headers > 0").collect()
    assert {(r["doc_id"], r["chunk_index"]) for r in got} == {(d, c) for d in range(0, 60, 3) for c in range(3)}


def test_plain_substitution_needs_its_neighbours(spark):
    rows = [(d, 0, 1, None, f"Room {d}: the quarterly committee report was read.") for d in range(300)] + [(900, 0, 1, None, "Here the quarterly comnittee report was read."), (901, 0, 1, None, "A lone comnittea stood.")]
    got = S.repair_pages(spark.createDataFrame(rows, "doc_id long, chunk_index int, page_no int, sheet_name string, text string")).where("misread > 0").collect()
    assert [(r["doc_id"], r["repaired"]) for r in got] == [(900, "Here the quarterly committee report was read.")]


def test_words_restored_on_damaged_pages(spark):
    """Sound pages of the tables, damaged by confusions and line-end hyphens, among all others: share of the damaged words that come back."""
    rows = spark.read.parquet("/root/testdata/sf0.01/chunks.parquet").where("text IS NOT NULL AND sheet_name IS NULL").dropDuplicates(["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "page_no", "sheet_name", "text").collect()
    noisy = {(r["doc_id"], r["chunk_index"]) for r in S.repair_pages(spark.read.parquet("/root/testdata/sf0.01/chunks.parquet")).where("noisy").collect()}
    r = random.Random(3)
    out, want = [], {}
    for d, c, p, s, t in rows:
        if (d, c) in noisy or not t.isascii() or "|" in t or r.random() < 0.7:
            out.append((d, c, p, s, t))
            continue
        words = t.split(" ")
        at = [i for i, w in enumerate(words) if w.isalpha() and w.islower() and len(w) > 5]
        for i in r.sample(at, min(4, len(at))):
            true, read = r.choice([x for x in (("m", "rn"), ("l", "1"), ("o", "0"), ("d", "cl"), ("e", "c"), ("i", "l")) if x[0] in words[i][1:]] or [("", "")])
            if true:
                k = words[i].index(true, 1)
                want.setdefault((d, c), []).append(words[i])
                words[i] = words[i][:k] + read + words[i][k + 1 :]
        out.append((d, c, p, s, " ".join(words)))
    got = {(x["doc_id"], x["chunk_index"]): x["repaired"] for x in S.repair_pages(spark.createDataFrame(out, "doc_id long, chunk_index int, page_no int, sheet_name string, text string")).collect()}
    clean = {(d, c): t for d, c, _, _, t in rows}
    back = sum(got[k].split().count(w) >= clean[k].split().count(w) for k, ws in want.items() for w in ws)
    whole = sum(map(len, want.values()))
    print(f"restored {back} of {whole}")
    assert whole > 150 and back / whole > 0.75
