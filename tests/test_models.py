"""Stages that ask a model, where the model fails, says nothing or says something else."""

from pyspark.sql import functions as F

from leafstack import registry
from leafstack.operators import models, retrieval


class Says:
    def __init__(self, reply):
        self.reply = reply

    def complete(self, prompt):
        if isinstance(self.reply, Exception):
            raise self.reply
        return self.reply


DOCS = "doc_id long, text string, domain string"


def docs(spark):
    return spark.createDataFrame([(1, "Customer survey. Q1. How often do you visit us?\nPlease rate your visit.", "Legal"), (2, None, None), (3, "", "Financial"), (4, "Paid on 01/02/2024: $5.50, 12 %. " * 2000, "Odd")], DOCS).withColumn("reply", F.lit("clash"))


def test_classify(spark):
    for reply, method in ((None, "heuristic"), (RuntimeError("down"), "heuristic"), ("no object", "heuristic"), ('{"type": "questionnaire", "confidence": 0.9, "domain": "Legal"}', "model")):
        got = {r["doc_id"]: r for r in models.classified(docs(spark), "text", Says(reply)).collect()}
        assert {r["method"] for r in got.values()} == {method} and len(got) == 4
    assert got[1]["probability"] > 0.6 and got[1]["domain"] == "Legal"
    failed = models.classified(docs(spark), "text", Says(RuntimeError("down"))).where("doc_id = 1").first()
    assert failed["warnings"] == ["RuntimeError: down"] and failed["domain"] == "General"


def test_summaries(spark):
    parts = spark.createDataFrame([(1, 0, "one", [1]), (2, 0, "a", [1]), (2, 1, "b", [2, 3])] + [(3, i, f"part {i}", [i]) for i in range(25)], "doc_id long, no int, text string, pages array<int>")
    got = {r["doc_id"]: r for r in models.summarised(parts, Says("Said.")).collect()}
    assert (got[1]["method"], got[2]["method"], got[2]["pages"]) == ("single", "map_reduce", [1, 2, 3])
    assert got[3]["warnings"] == ["only the first 20 of 25 parts were summarised"] and got[3]["parts"] == 20
    silent = {r["doc_id"]: r for r in models.summarised(parts, Says("")).collect()}
    assert all(r["summary"] is None and r["method"] == "extractive" for r in silent.values()) and silent[2]["parts"] == 0
    assert models.summarised(parts.limit(0), Says("x")).count() == 0
    assert models.summarised(parts.where("doc_id = 1"), Says(("Half", "length"))).first()["warnings"] == ["reply cut at the token limit"]


def test_questions(spark):
    got = {r["doc_id"]: r for r in models.all_questions(docs(spark), "text", Says('{"questions": ["How often do you come?", "a) Yes", "x"]}')).collect()}
    assert got[1]["method"] == "hybrid" and got[1]["questions"][0] == "How often do you come?" and got[4]["method"] == "model"
    none = {r["doc_id"]: r["method"] for r in models.all_questions(docs(spark), "text", Says(None)).collect()}
    assert none[1] == "regex" and 4 not in none


def test_fields(spark):
    got = {r["doc_id"]: r for r in models.extracted(docs(spark), "text", "domain", Says('Sure: {"parties": "A and B", "penalties": "", "revenue": "5", "other": 1}')).collect()}
    assert got[1]["fields"] == {"parties": "A and B"} and got[3]["fields"] == {"revenue": "5"} and got[4]["method"] == "regex" and "dates" in got[4]["fields"]


def test_answers(spark):
    asked = spark.createDataFrame([(1, "Why?"), (2, "What?")], "q_id int, question string")
    contexts = spark.createDataFrame([(1, "[Page 1]\ntext")], "q_id int, context string")
    got = {r["q_id"]: r for r in models.answered(asked, contexts, Says("Because."), True).collect()}
    assert (got[1]["reply"], got[1]["error"], got[2]["reply"], got[2]["error"]) == ("Because.", None, None, "no context")
    assert models.answered(asked, contexts, Says(ValueError("no")), False).where("q_id = 1").first()["error"] == "ValueError: no"


def test_selection(spark):
    passages = spark.createDataFrame([(s, 10 * s + i, f"p{i // 2}", size) for s in (1, 2) for i, size in enumerate((100, 200, 300, 400, 500, 600, 700, 800))], "scope int, pos long, source string, size int")
    questions = spark.createDataFrame([(1, 1), (2, 2), (3, 9)], "q_id int, scope int")
    scored = spark.createDataFrame([(1, 15, 4), (1, 14, 4), (1, 12, 1)], "q_id int, pos long, score long")
    rows = retrieval.select_context(scored, passages, questions, 3, True).orderBy("q_id", "rank").collect()
    assert [(r["q_id"], r["pos"], r["ranked"]) for r in rows] == [(1, 14, True), (1, 12, True), (1, 10, True), (1, 17, False), (2, 20, True), (2, 21, True), (2, 22, True)]
    tight = retrieval.select_context(scored, passages, questions.where("q_id = 1"), 3, True, 50).collect()
    assert [(r["pos"], r["ranked"], r["running"]) for r in tight] == [(10, True, 100)]
    assert retrieval.select_context(scored, passages.limit(0), questions, 3, True).count() == 0


def test_contract(spark):
    rows = docs(spark)
    assert registry.run("nothing", rows).error == "ValueError: no operator nothing"
    assert "chunk_index" in registry.run("page_offsets", rows).error
    done = registry.run("sections", rows, "text", act=True)
    assert done.success and done.result is not None and done.seconds > 0
    assert not registry.run("sections", rows, "no_such_column").success
