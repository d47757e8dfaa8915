"""Operators on small fixtures with expected values worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafstack import providers
from leafstack.functions import text as T
from leafstack.operators import chunking, classify, evaluate, questions, retrieval, store, tables, vectors
from leafstack.providers.keys import KeyPool, Refused
from leafstack.registry import analyse, register
from leafstack.sources import files, xlsx
from leafstack.streaming import ingest


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()[0][0]


@pytest.mark.parametrize(("text", "want"), [("Hello-\nworld\n\n\n\n  trailing  \nPage 1", "Helloworld\n\n  trailing"), ("a\r\nb\rc", "a\nb\nc"), ("", ""), (None, None), ("3 / 9\nx\n•\n", "x")])
def test_clean(spark, text, want):
    assert one(spark, text, T.clean) == want


@pytest.mark.parametrize(("text", "want"), [("Q3 Revenue was 9140000 in EMEA", ["emea", "q3", "revenue"]), ("", []), ("the and of", []), ("ÄRGER über a8800", ["a8800"])])
def test_tokens(spark, text, want):
    assert sorted(one(spark, text, T.content_tokens)) == want


@pytest.mark.parametrize(("text", "want"), [("28m3.936s", 1683.936), ("1h16m19.2s", 4579.2), ("185ms", 0.185), ("60", 60.0), ("junk", None), ("", None), (None, None)])
def test_duration(spark, text, want):
    got = one(spark, text, T.duration_seconds)
    assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(("reply", "part", "want"), [("founded 1987", "19", False), ("1.94", "94", False), ("19. Next", "19", True), ("21,500,000", "21500000", True), ("a four-year plan", "four year", True), ("x", "", False)])
def test_whole_value(spark, reply, part, want):
    assert spark.createDataFrame([(reply, part)], "r string, p string").select(T.contains_value(F.col("r"), F.col("p"))).collect()[0][0] is want


@pytest.mark.parametrize(("doc", "page", "sheet", "want"), [(None, 3, None, "Page 3"), (None, None, "Q3 Revenue", "Sheet: Q3 Revenue"), (None, None, None, "Unknown source"), ("report.pdf", 3, None, "report.pdf, Page 3")])
def test_source_label(spark, doc, page, sheet, want):
    df = spark.createDataFrame([(doc, page, sheet)], "d string, p int, s string")
    assert df.select(T.source_label(F.col("d"), F.col("p"), F.col("s"))).collect()[0][0] == want


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(457, 100, 20, 6), (100, 100, 20, 1), (30, 100, 20, 1), (300, 50, 50, 8), (0, 100, 20, 1)])
def test_passages(spark, n, size, overlap, want):
    text = " ".join(f"w{i}" for i in range(n))
    rows = chunking.passages(spark.createDataFrame([(1, text, "clash")], "doc_id int, text string, passage_extra string"), size, overlap).collect()
    assert len(rows) == want
    assert {w for r in rows for w in r["passage"].split()} == set(text.split())


def test_passages_null_and_empty_table(spark):
    assert [r["passage"] for r in chunking.passages(spark.createDataFrame([(1, None)], "doc_id int, text string")).collect()] == [""]
    assert chunking.passages(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_boundary_offsets_cover_and_overlap():
    text = "One sentence here. " * 400
    cuts = chunking.boundary_offsets(text, 1000, 100)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b - a <= 1000 + 2 for a, b in cuts) and all(c == b - 100 for (_, b), (c, _) in zip(cuts, cuts[1:]))
    assert chunking.boundary_offsets("x" * 5000, 1000, 100)[-1][1] == 5000


def test_sections():
    text = "# First\nbody one\n# Second\nbody two\nSECTION THREE\nbody three"
    assert chunking.find_sections(text) == [("First", "body one"), ("Second", "body two"), ("SECTION THREE", "body three")]
    assert "".join(chunking.pack_sections([("a", "x" * 10), ("b", "y" * 10)], 60, 5)).count("##") == 2


def test_page_overlap_is_the_interval_join(spark):
    chunks = spark.createDataFrame([(1, 0, "a" * 5000), (1, 1, "b" * 100), (1, 2, "c" * 9000), (1, 3, " "), (2, 0, None)], "doc_id int, chunk_index int, text string")
    got = {(r["doc_id"], r["slice"]): r["pages"] for r in chunking.page_overlap(chunking.page_offsets(chunks)).collect()}
    spans = [(0, 0, 5000), (1, 5002, 5102), (2, 5104, 14104)]
    assert got == {(1, s): [i for i, a, b in spans if a < (s + 1) * 4000 and b > s * 4000] for s in range(4)}


@pytest.mark.parametrize(("p", "kind", "want"), [(0.03, "normal_document", 0.97), (0.96, "questionnaire", 0.96), (None, "normal_document", 1.0)])
def test_verdict(spark, p, kind, want):
    df = spark.createDataFrame([(p, kind)], "p double, k string")
    assert df.select(classify.verdict_confidence(F.col("p"), F.col("k"))).collect()[0][0] == pytest.approx(want)


def test_blend(spark):
    assert one(spark, 0.96, lambda c: classify.blend(c, F.lit(0.0)), "double") == pytest.approx(0.672)


def test_plan_of_audio(spark):
    df = spark.createDataFrame([("audio", "questionnaire")], "f string, d string")
    got = df.select(classify.stage_plan(F.col("f"), F.col("d"), F.lit("Financial"), F.lit(False)).alias("p")).collect()[0]["p"]
    assert got == ["text_cleaner", "document_classifier", "summarization", "question_extraction"]


def test_questions(spark):
    text = "Q1. How often do you come?\n2) Please describe your problem in detail\na) Yes\nName: ____\nWhat else is there to say?\n"
    got = [r["question"] for r in questions.extract(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, t string"), "t").collect()]
    assert "How often do you come?" in got and "What else is there to say?" in got and not any(q.startswith("Yes") for q in got)
    assert questions.greedy(["What is your age?", "what is your age", "What is your exact age in years?"]) == ["What is your age?", "What is your exact age in years?"]


def test_distinct_sources_ties_and_budget(spark):
    rows = spark.createDataFrame([(1, 5, 2, "a", 4000), (1, 3, 2, "b", 1500), (1, 4, 2, "b", 10), (1, 9, 1, "c", 900), (1, 10, 1, "d", 0)], "q_id int, pos int, score int, label string, n int")
    top = retrieval.distinct_sources(rows, ["label"], 3)
    assert [(r["pos"], r["rank"]) for r in top.orderBy("rank").collect()] == [(3, 1), (5, 2), (9, 3)]
    assert [r["pos"] for r in retrieval.char_budget(top, F.col("n")).orderBy("rank").collect()] == [3, 5]


def test_vector_top_against_brute_force(spark):
    rows = [(i, [float(i % 7), float(i % 3) - 1, 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.vector_top(v.where("vec_id < 3").withColumnRenamed("vec_id", "q_id"), v, 5, 2, 9).collect()
    assert len(got) == 15 and all(r["score"] == pytest.approx(1.0) for r in got if r["vec_id"] == r["q_id"])


def test_upsert_and_delete(spark, tmp_path):
    schema = "file_hash string, id long, created_at long, v string"
    path = str(tmp_path / "store")
    store.save(spark.createDataFrame([("a", 1, 1, "old"), ("b", 2, 1, "b")], schema), path)
    store.save(spark.createDataFrame([("a", 3, 2, "new"), ("a", 3, 2, "new")], schema), path)
    assert sorted((r["file_hash"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", "new"), ("b", "b")]
    store.delete(spark, path, "file_hash = 'b'")
    assert spark.read.parquet(path).count() == 1


def test_display_names(spark):
    rows = spark.createDataFrame([(2, "report.pdf", 2), (1, "report.pdf", 1), (3, None, 1)], "id int, file_name string, created_at int")
    assert {r["id"]: r["display"] for r in store.display_names(rows).collect()} == {2: "report.pdf", 1: "report.pdf (#1)", 3: None}


def test_head_tail(spark):
    rows = spark.range(1000).select(F.lit("x").alias("g"), "id")
    assert tables.head_tail(rows, ["g"], ["id"], 10).count() == 20
    assert tables.head_tail(rows.limit(15), ["g"], ["id"], 10).count() == 15


def test_similar_sets_against_brute_force(spark):
    import random

    r = random.Random(3)
    sets = [(f"s{i}", sorted({r.choice("abcdefghij") for _ in range(r.randint(1, 8))})) for i in range(60)]
    got = {(x["q_a"], x["q_b"]) for x in evaluate.similar_sets(spark.createDataFrame(sets, "q string, t array<string>"), 0.6).collect()}
    assert got == {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6}


def test_vector_codec():
    assert vectors.decode(vectors.encode([1.0, 2.0]), 2).tolist() == [[1.0, 2.0]]
    assert vectors.decode("!!", 2) is None and vectors.decode(vectors.encode([1.0]), 2) is None


def test_workbook_round_trip():
    sheets = [("Q3 & Sales", [["Region", "Units"], ["North", "12"], ["", "7"]]), ("Empty", [])]
    assert xlsx.read_workbook(xlsx.write_workbook(sheets)) == sheets


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(xlsx.write_workbook([("S", [["Name", "Pay"], ["Ann", "5"]])]))
    (folder / "b.csv").write_text("Col1,Col2\nx,1\ny,2\n")
    (folder / "c.docx").write_bytes(b"no")
    (folder / "d.xlsx").write_bytes(b"broken")
    rows = {r["file_name"]: r for r in files.read_files(spark, str(folder)).collect()}
    assert "Ann | 5" in rows["a.xlsx"]["text"] and "- Total Rows: 2" in rows["b.csv"]["text"]
    assert rows["c.docx"]["error"].startswith("ValueError: unsupported") and rows["d.xlsx"]["error"]
    for _ in range(2):
        ingest.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_usage_windows(spark):
    calls = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 2.0), ("2024-01-01 00:07:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r["value"] for r in ingest.usage_windows(calls).collect()) == [3.0, 4.0]


class Fails(providers.Offline):
    def complete(self, prompt):
        raise RuntimeError("no")


def test_providers(spark):
    rows = spark.createDataFrame([(1, "One. Two."), (2, "One. Two."), (3, None), (4, "")], "id int, t string")
    assert {r["id"]: r["value"] for r in providers.apply(rows, "t", providers.Offline()).collect()} == {1: "One.", 2: "One.", 3: None, 4: None}
    assert {r["error"] for r in providers.apply(rows, "t", providers.Offline(), "embed").collect()} == {None}
    stored = rows.withColumn("e", F.when(F.col("id") == 1, F.array(F.lit(1.0))))
    got = {r["id"]: r["e"] for r in providers.fill_gaps(stored, "t", "e", providers.Offline(8)).collect()}
    assert got[1] == [1.0] and len(got[2]) == 8 and got[3] is None


def test_key_pool():
    now = [0.0]
    pool = KeyPool(["a", "b", "c"], clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    faults = {"a": Refused(401), "b": Refused(429, 60.0)}

    def call(key):
        if key in faults:
            raise faults[key]
        return key

    assert pool.run(call) == "c" and pool.live() == ["c"]
    now[0] = 61
    assert pool.live() == ["b", "c"]
    assert KeyPool(["a"], sleep=lambda s: None).run(lambda k: (_ for _ in ()).throw(Refused(400))) is None


def test_analyse(spark):
    text = "Survey\nQ1. How often do you come?\nplease select one of these\n[ ] a\n(a) Yes\nStrongly agree\n" + "This is a long sentence about the yearly plan. " * 3
    rows = {r["doc_id"]: r for r in analyse(spark.createDataFrame([(1, "a.pdf", "pdf", text), (2, "b.pdf", "pdf", None)], "doc_id int, file_name string, file_type string, full_text string")).collect()}
    assert rows[1]["doc_type"] == "questionnaire" and rows[1]["questions"] and rows[2]["summary"] is None
    with pytest.raises(ValueError):
        register("summarization", analyse)


def test_json_is_json(spark):
    from leafstack.plans.store import result_json
    from tests.conftest import DATA

    assert all(json.loads(r["result_json"]) for r in result_json(spark, DATA).collect())


def test_section_summaries(spark):
    from leafstack.operators import summarize

    body = "The yearly plan was reviewed by the committee. " * 3
    docs = spark.createDataFrame([(1, f"# First\n{body}\n# Second\n{body}"), (2, body), (3, None), (4, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["summary"] for r in summarize.by_section(docs, chunking.sections(docs, "text")).collect()}
    assert got[1].startswith("**First**\nThe yearly") and "**Second**" in got[1] and got[2].startswith("The yearly") and set(got) == {1, 2}


@pytest.mark.parametrize("descending", [False, True])
def test_running_sum_against_brute_force(spark, descending):
    from leafstack.operators.running import running_sum

    rows = [("a" if i % 3 else None, i, i % 5 if i % 7 else None) for i in range(0, 400, 3)]
    got = running_sum(spark.createDataFrame(rows, "k string, o int, v int"), "k", "o", "v", "s", descending, block=16).collect()
    for r in got:
        assert r["s"] == sum(v or 0 for k, o, v in rows if k == r["k"] and (o >= r["o"] if descending else o <= r["o"]))
    assert len(got) == len(rows)


def plain_fold(found):
    """The questions kept, by the definition: each against all kept ones."""
    kept = []
    for q in found:
        words = set(" ".join(q.lower().strip().rstrip("?. ").split()).split())
        scores = [len(words & w) / len(words | w) if words | w else 0.0 for _, w in kept]
        if scores and max(scores) >= 0.72:
            at = scores.index(max(scores))
            if len(q) > len(kept[at][0]):
                kept[at] = (q, words)
        else:
            kept.append((q, words))
    return [q for q, _ in kept]


def test_greedy_against_every_pair():
    r = random.Random(2)
    for _ in range(300):
        found = [" ".join(r.choice("what is your name age town please now here".split()) for _ in range(r.randint(0, 6))) + r.choice(["?", "", "."]) for _ in range(r.randint(0, 25))]
        assert questions.greedy(found) == plain_fold(found)
    assert questions.greedy(["a b c d e f g h", "a b c d e f g x y", "a b c d e f g h y"]) == ["a b c d e f g h y", "a b c d e f g x y"][:2]


def test_cap_comes_after_duplicates(spark):
    rows = [(1, i, f"Is the item number {i % 150} here" + " now" * (i // 150)) for i in range(400)] + [(1, 400, "Entirely different question text")]
    got = questions.greedy_distinct(spark.createDataFrame(rows, "doc_id int, pos int, question string")).first()["questions"]
    assert len(got) <= 200 and len(got) == len(set(got))


def plain_cuts(text, size, overlap):
    out, first = [], 0
    while first < len(text):
        end = min(first + size, len(text))
        if end < len(text):
            for b in chunking.BREAKS:
                places = [i for i in range(first + overlap, end - len(b) + 1) if text.startswith(b, i)]
                if places:
                    end = places[-1] + len(b)
                    break
        out.append((first, end))
        if end == len(text):
            return out
        first = max(first + 1, end - overlap)
    return out


def test_boundaries_against_every_place():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", ". ", ".\n", "\n\n", "\n", "? ", "! ", "; ", ".", " "]) for _ in range(r.randint(0, 120)))
        size = r.randint(2, 30)
        overlap = r.randint(0, size - 1)
        assert chunking.boundary_offsets(text, size, overlap) == plain_cuts(text, size, overlap)


def test_packed_before_cut():
    small, large = ("a", "x" * 10), ("b", ("y" * 9 + ". ") * 20)
    assert chunking.pack_sections([small, small], 60, 5) == ["## a\n\nxxxxxxxxxx\n\n## a\n\nxxxxxxxxxx"]
    got = chunking.pack_sections([small, large, small], 60, 5)
    assert got[0] == "## a\n\nxxxxxxxxxx" and got[1].startswith("## b\n\n") and got[-1] == "## a\n\nxxxxxxxxxx" and len(got) > 4
    assert chunking.pack_sections([("c", "z" * 80)], 60, 5) == ["## c\n\n" + "z" * 80]
