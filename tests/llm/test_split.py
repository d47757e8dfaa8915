import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leafstack.llm import split

RULES = [("pdf", 40, 8), ("odd", None, 3), ("zero", 0, 0)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n!é́", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_offsets_cover_and_overlap(text, size, overlap):
    cuts = split.split_offsets(text, size, overlap)
    shared = min(overlap, size - 1)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(e - s <= size for s, e, _ in cuts)
    if len(text) > size:
        assert len(cuts) > 1
        assert all(b[0] == max(a[1] - shared, a[0] + 1) for a, b in zip(cuts, cuts[1:]))
    else:
        assert len(cuts) == 1


def test_natural_boundaries():
    text = "First paragraph here.\n\nSecond one. It goes on and on.\n\nThird"
    cuts = split.split_offsets(text, 40, 4)
    assert [text[s:e] for s, e, _ in cuts][0] == "First paragraph here.\n\n"
    assert cuts[0][2] == "paragraph"
    assert [b for *_, b in split.split_offsets("x" * 100, 40, 0)][0] == "character"


def test_table(spark):
    docs = spark.createDataFrame([(1, "pdf", "word " * 30, "a"), (1, "pdf", "word " * 30, "a"), (2, "pdf", None, "b"), (3, "pdf", "", "c"), (4, "none", "x" * 99, "d"), (5, "odd", "x" * 99, "e"), (6, "zero", "x" * 99, "f"), (7, None, "x" * 99, "g"), (8, "pdf", "y" * 200_000, "h")], "doc_id long, file_type string, full_text string, piece string")
    rules = spark.createDataFrame(RULES, "file_type string, chunk_size int, chunk_overlap int")
    got = split.split_texts(docs, rules)
    n = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n[1] % 2 == 0 and n[1] > 6 and 2 not in n and n[3] == 1 and n[4] == n[5] == n[6] == n[7] == 1 and n[8] > 6000
    assert split.split_texts(docs.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        split.split_offsets("a", 0, 0)


def test_found_equals_sql(spark):
    from leafstack.llm.queries import oracle_sql, p1_found
    from tests.conftest import DATA
    from tests.oracle import connect, same_rows

    assert same_rows(p1_found(spark, DATA), connect(DATA), oracle_sql()["p1_found"]) > 0


def test_pieces_of_the_tables(spark):
    """Over all documents: pieces within the limit, the exact overlap between them, and together the text."""
    from leafstack.llm.queries import p1_pieces

    root = "/root/testdata/sf0.01"
    rules = {r["file_type"]: r for r in spark.read.parquet(f"{root}/summarization_config.parquet").collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{root}/parsed_documents.parquet").where("full_text IS NOT NULL").collect()}
    pieces = {}
    for r in p1_pieces(spark, root).orderBy("doc_id", "piece_index").collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == docs.keys()
    for k, got in pieces.items():
        text, rule = docs[k]["full_text"], rules[docs[k]["file_type"]]
        assert all(len(p["piece"]) <= rule["chunk_size"] and p["piece"] == text[p["start"] : p["end"]] for p in got)
        assert (got[0]["start"], got[-1]["end"]) == (0, len(text))
        assert all(a["end"] - b["start"] == rule["chunk_overlap"] for a, b in zip(got, got[1:]))
