import random

import numpy as np

from leafstack.llm import dedup


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_subsequence_against_table():
    r = random.Random(4)
    for _ in range(60):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 30))] for _ in range(2))
        assert dedup.common_subsequence(np.array(a, np.uint32), np.array(b, np.uint32)) == lcs(a, b)


def test_normal_words():
    assert dedup.normal_words("Émile’s  CAFÉ, no. 5") == ["emile", "s", "cafe", "no", "5"]
    assert dedup.normal_words(None) == dedup.normal_words(" ,.\n") == []


def make(spark):
    r = random.Random(5)
    text = lambda: [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 4) + str(r.randint(0, 300)) for _ in range(60)]
    base = [text() for _ in range(40)]
    history = [(i, " ".join(w), f"H{i}", 0) for i, w in enumerate(base)] + [(40, None, "ABC", 0), (41, "", "q", 0), (42, None, None, 0), (43, None, "", 0), (0, " ".join(base[0]), "H0", 0)]
    near = list(base[3])
    for i in range(0, 60, 6):
        near[i] = f"new{i}"
    far = [w if i % 3 else f"x{i}" for i, w in enumerate(base[4])]
    incoming = [(100, " ".join(base[1]).upper() + ".", "other", 1), (101, " ".join(near), None, 1), (102, " ".join(far), "H4", 1), (103, None, "abc", 2), (104, " ", "q", 2), (105, None, "", 2), (106, " ".join(near[5:]), "z", 2), (107, " ".join(base[1]), "z", 3), (None, "x", "x", 3), (108, "word " * 5000, "l", 3)]
    schema = "id long, content_text string, file_hash string, batch_no int"
    return spark.createDataFrame(history, schema).selectExpr("*", "'c' AS words", "'d' AS class"), spark.createDataFrame(incoming, schema)


WANT = {(1, 100), (3, 101), (40, 103), (41, 104), (101, 106), (1, 107), (100, 107)}


def test_pairs(spark):
    history, incoming = make(spark)
    got = [(r["id_a"], r["id_b"]) for r in dedup.repeated_rows(history, incoming).collect()]
    texts = {r["id"]: dedup.normal_words(r["content_text"]) for r in history.union(incoming.selectExpr("*", "''", "''")).collect() if r["id"] is not None}
    brute = {(a, b) for b in range(100, 108) for a in texts if a < b and texts[a] and texts[b] and lcs(texts[a], texts[b]) >= 0.8 * max(len(texts[a]), len(texts[b]))}
    assert len(got) == len(set(got)) and set(got) == brute | {(40, 103), (41, 104)} == WANT


def test_batches_give_the_same(spark):
    history, incoming = make(spark)
    assert {(r["id_a"], r["id_b"]) for r in dedup.check_batches(history, incoming).collect()} == WANT


def test_empty_tables(spark):
    history, incoming = make(spark)
    assert dedup.repeated_rows(history, incoming.limit(0)).count() == 0
    assert {(r["id_a"], r["id_b"]) for r in dedup.repeated_rows(history.limit(0), incoming).collect()} == {(101, 106), (100, 107)}


def test_hot_group_of_copies(spark):
    history = spark.range(300).selectExpr("id", "'the same old text about nothing in particular' AS content_text", "'h' AS file_hash")
    incoming = spark.createDataFrame([(1000, "The same old text about nothing in particular!", None)], "id long, content_text string, file_hash string")
    assert dedup.repeated_rows(history, incoming).count() == 300


def test_third_of_rows_are_variants(spark):
    r = random.Random(8)
    words = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    base = words(60)

    def variant():
        own = list(base)
        for i in r.sample(range(60), 6):
            own[i] = f"w{r.randint(0, 10**6)}"
        return own

    texts = [base, *(variant() for _ in range(99)), *(words(60) for _ in range(200))]
    new = [base[:30] + words(2) + base[32:], *(variant() for _ in range(10))]
    history = spark.createDataFrame([(i, " ".join(w), None) for i, w in enumerate(texts)], "id long, content_text string, file_hash string")
    incoming = spark.createDataFrame([(1000 + i, " ".join(w), None) for i, w in enumerate(new)], "id long, content_text string, file_hash string")
    rows = dict(enumerate(texts)) | {1000 + i: w for i, w in enumerate(new)}
    want = {(a, b) for b in rows if b >= 1000 for a in rows if a < b and lcs(rows[a], rows[b]) >= 48}
    got = {(x["id_a"], x["id_b"]) for x in dedup.repeated_rows(history, incoming).collect()}
    assert len(want) > 500 and got <= want and len(got) >= 0.99 * len(want)


def test_batches_in_any_order_of_ids(spark):
    text = " ".join(f"word{i}" for i in range(30))
    history = spark.createDataFrame([(5, text, None), (900, text, None)], "id long, content_text string, file_hash string")
    incoming = spark.createDataFrame([(700, text, None, 1), (600, text, None, 2), (800, text, None, None)], "id long, content_text string, file_hash string, batch_no int")
    got = {(r["id_a"], r["id_b"], r["batch"]) for r in dedup.check_batches(history, incoming).collect()}
    assert got == {(5, 700, 1), (5, 600, 2), (600, 700, 2), (5, 800, None), (700, 800, None), (600, 800, None)}
    links = {(r["id"], r["first_id"], r["links"]) for r in dedup.link_counts(dedup.repeated_rows(history, incoming), incoming).collect()}
    assert links == {(700, 5, 3), (600, 5, 3), (800, 5, 3)}


def test_form_letters_and_long_texts(spark):
    """Forms that differ in a few words, and texts of 1 500 words; recall by brute force."""
    r = random.Random(9)
    form = [f"f{i}" for i in range(400)]

    def letter(n):
        own = list(form)
        for i in r.sample(range(400), n):
            own[i] = f"x{r.randint(0, 10**7)}"
        return own

    long = [f"l{r.randint(0, 3000)}" for _ in range(1500)]
    longer = [w if r.random() > 0.12 else f"y{i}" for i, w in enumerate(long)]
    texts = {i: letter(r.choice((4, 5, 6, 20, 40))) for i in range(60)} | {100: long, 101: [f"l{r.randint(0, 3000)}" for _ in range(1500)]}
    new = {1000 + i: letter(r.choice((4, 6, 30))) for i in range(8)} | {1100: longer}
    frame = lambda t: spark.createDataFrame([(i, " ".join(w), None) for i, w in t.items()], "id long, content_text string, file_hash string")
    rows = texts | new
    n = {k: np.array([hash(w) & 0xFFFFFFFF for w in v], np.uint32) for k, v in rows.items()}
    want = {(a, b) for b in new for a in rows if a < b and dedup.same_document(n[a], n[b])}
    got = {(x["id_a"], x["id_b"]) for x in dedup.repeated_rows(frame(texts), frame(new)).collect()}
    assert (100, 1100) in got and got <= want and len(got) >= 0.98 * len(want)


def test_reads_stay_flat(spark):
    """A batch of one row meets parts of one size, however large the history."""
    r = random.Random(10)
    read = []
    for rows in (200, 2000):
        history = spark.createDataFrame([(i, " ".join(f"w{r.randint(0, 10**6)}" for _ in range(40)), None) for i in range(rows)], "id long, content_text string, file_hash string")
        index = dedup.HistoryIndex(spark, parts=rows // 4)
        index._add("keys", dedup.exploded(dedup.prepare(history).withColumnRenamed("id", "rep")), "k")
        batch = dedup.prepare(spark.createDataFrame([(9999, " ".join(f"v{i}" for i in range(40)), None)], history.schema))
        keys = batch.selectExpr("explode(keys) AS k")
        read.append(index.table("keys", keys.select(index.part("k"))).count())
    assert read[1] < 2 * read[0]


def test_known_wording_meets_its_near_copies(spark):
    """A new row whose wording is known repeats the near-copies of that wording too."""
    words = [f"word{i}" for i in range(30)]
    history = spark.createDataFrame([(1, " ".join(words), None), (2, " ".join(words[2:]), None)], "id long, content_text string, file_hash string")
    incoming = spark.createDataFrame([(10, " ".join(words), None, 1)], "id long, content_text string, file_hash string, batch_no int")
    assert {(r["id_a"], r["id_b"]) for r in dedup.check_batches(history, incoming).collect()} == {(1, 10), (2, 10)}


def test_texts_of_one_form_are_told_apart_by_their_sketches(spark):
    """Texts that share two in five phrases share band keys, but few of them may reach the comparison of words; near-copies all must."""
    r = random.Random(12)
    phrases = [[f"f{i}x{j}" for j in range(5)] for i in range(24)]
    texts = [[w for p in r.sample(phrases, 10) for w in p] + [f"o{n}x{j}" for j in range(4)] for n in range(120)]
    near = [[f"c{n}x{j}" if j % 6 == 5 else w for j, w in enumerate(t)] for n, t in enumerate(texts[:60])]
    rows = spark.createDataFrame([(i, " ".join(w), None) for i, w in enumerate(texts + near)], "id long, content_text string, file_hash string")
    keys = dedup.exploded(dedup.prepare(rows).withColumnRenamed("id", "rep")).cache()
    one, other = keys.selectExpr("key", "rep AS a"), keys.selectExpr("key", "rep AS b")
    meet = {(x["a"], x["b"]) for x in one.join(other, "key").where("a < b").distinct().collect()}
    got = {(x["a"], x["b"]) for x in dedup.candidate_pairs(keys.drop("k"), keys.drop("k").limit(0), []).collect()}
    same = {(n, 120 + n) for n in range(60)}
    assert len(meet - same) > 2_000 and len(got - same) < 0.1 * len(meet - same)
    assert got <= meet and len(got & same) >= 0.98 * len(same)


def test_classes_do_not_depend_on_the_filter(spark, monkeypatch):
    """A wording that stands once is taken as it is; where the filter lets everything through the classes are the same."""
    history = spark.createDataFrame([(5, "one two three", None), (9, "four five six", None), (7, "four five six", None)], "id long, content_text string, file_hash string")
    batch = spark.createDataFrame([(3, "Four five six", None), (20, "new words here", None), (21, "new words here", None), (22, "a wording alone", None), (22, "a wording alone", None), (23, "stands once", None), (24, None, "x")], history.schema)
    got = []
    for bits in (dedup.FILTER_BITS, 1):
        monkeypatch.setattr(dedup, "FILTER_BITS", bits)
        index = dedup.HistoryIndex(spark)
        index.append(dedup.prepare(history), seed=True)
        got.append(sorted((r["rep"], r["fresh"], len(r["words"]) // 4) for r in index._texts(dedup.prepare(batch), []).collect()))
    assert got[0] == got[1] == [(7, False, 3), (20, True, 3), (22, True, 3), (23, True, 2)]
