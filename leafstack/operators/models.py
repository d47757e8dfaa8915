"""Stages that ask a model: prompts as columns, one call per distinct prompt, replies parsed on the cluster, failures as values.

Every stage states in ``method`` whether the model's reply was used, and in ``warnings`` what went wrong. A provider that is
missing, fails or answers nothing usable never fails a row: the stage falls back to what needs no model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafstack.functions import text as T
from leafstack.operators import chunking, classify, questions, reports
from leafstack.providers import Provider, apply

#: Characters of a text that classification and extraction read, windows of a text that are searched for questions, parts of a text that are summarised.
CLASSIFY_CHARS, EXTRACT_CHARS, MOST_WINDOWS, MOST_PARTS = 3000, 8000, 20, 20
#: Fields of each domain.
FIELDS = {
    "Financial": ("revenue", "net_income", "eps", "guidance", "fiscal_period", "key_metrics", "risks"),
    "Legal": ("parties", "effective_date", "termination_date", "governing_law", "obligations", "defined_terms", "penalties"),
    "Healthcare": ("patient_id", "diagnoses", "medications", "procedures", "dates", "physician", "allergies"),
    "Research": ("title", "authors", "hypothesis", "methodology", "findings", "limitations", "datasets"),
    "General": ("dates", "organisations", "people", "locations", "monetary_values", "key_facts"),
}
#: Between a prompt and the text it is about, and between the parts of a summary or context.
TEXT, RULE = "\n\nText:\n", "\n\n---\n\n"


def prompt(task: str, order: str, body: Column) -> Column:
    return F.concat(F.lit(f"Task: {task}. {order}{TEXT}"), body)


def asked(rows: DataFrame, body: Column, provider: Provider, to: str = "reply") -> DataFrame:
    """``rows`` with the model's reply (null where it failed or said nothing) and ``warnings``: the error, or that the reply was cut."""
    called = apply(rows.withColumn("__prompt", body), "__prompt", provider).drop("__prompt")
    bare = F.when(T.strip(F.col("value")) != "", F.col("value"))
    cut = F.when(F.col("reason") == "length", "reply cut at the token limit")
    return called.withColumn(to, bare).withColumn("warnings", F.array_compact(F.array(F.col("error"), cut))).drop("value", "error", "reason")


def reply_object(c: Column) -> Column:
    """The reply if it is an object, else the first object without inner braces in it; null if there is none."""
    bare = T.strip(T.unfenced(c))
    return F.when(F.get_json_object(bare, "$").startswith("{"), bare).otherwise(F.nullif(F.regexp_extract(c, r"\{[^{}]*\}", 0), F.lit("")))


def kept_fields(c: Column, fields: Column) -> Column:
    """Of an object in JSON the known fields with a value: null, false, 0, empty strings, lists and objects are none."""
    every = F.from_json(c, "map<string,string>")
    return F.map_filter(every, lambda k, v: F.array_contains(fields, k) & v.isNotNull() & ~v.isin("", "false", "0", "0.0", "[]", "{}"))


def classified(docs: DataFrame, text: str, provider: Provider, threshold: float = 0.35) -> DataFrame:
    """``doc_id, probability, doc_type, domain, method, warnings``: the model's verdict blended with the heuristic one.

    A reply without a usable object leaves the heuristic alone and a warning. A null text counts as empty.
    """
    base = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    rows = asked(base, prompt("classify", 'Answer with an object: "type" (questionnaire or normal_document), "confidence", "domain".', F.left("text", F.lit(CLASSIFY_CHARS))), provider)
    found = F.from_json(reply_object(F.col("reply")), "type string, confidence double, domain string")
    rows = rows.withColumn("o", found).withColumn("model", F.when(F.col("o.type").isNotNull() | F.col("o.confidence").isNotNull(), F.when(F.coalesce("o.type", F.lit("")) == "questionnaire", F.coalesce("o.confidence", F.lit(0.5))).otherwise(1 - F.coalesce("o.confidence", F.lit(0.5)))))
    rows = rows.join(classify.scored(base, "text").select("doc_id", "score"), "doc_id")
    p = F.when(F.col("model").isNull(), F.col("score")).otherwise(classify.blend(F.col("model"), F.col("score")))
    lost = F.when(F.col("model").isNull() & F.col("reply").isNotNull(), "reply of the model discarded")
    return rows.select("doc_id", F.round(p, 6).alias("probability"), classify.verdict(p, threshold).alias("doc_type"), F.coalesce("o.domain", F.lit("General")).alias("domain"), F.when(F.col("model").isNull(), "heuristic").otherwise("model").alias("method"), F.array_compact(F.concat("warnings", F.array(lost))).alias("warnings"))


def summarised(parts: DataFrame, provider: Provider, most: int = MOST_PARTS) -> DataFrame:
    """``doc_id, summary, method, parts, pages, warnings`` from ``doc_id, no, text, pages`` (page numbers of each part).

    One part is summarised at once. Of more the facts are drawn part by part (a part without a reply drops out), tagged with
    their pages and reduced to one summary. Parts beyond ``most`` are left to the caller with a warning. ``summary`` is null where the model gave none.
    """
    order = W.partitionBy("doc_id").orderBy("no")
    total = parts.groupBy("doc_id").agg(F.count("*").alias("total"))
    held = parts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).join(total, "doc_id")
    source = F.concat(F.lit("[Source: Pages "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("]\n"))
    whole = asked(held.where("total = 1"), prompt("summarise", "Summarise.", F.col("text")), provider, "summary")
    whole = whole.select("doc_id", "summary", F.lit("single").alias("kind"), F.lit(1).cast("bigint").alias("parts"), "pages", "warnings")
    facts = asked(held.where("total > 1"), prompt("facts", "List the facts.", F.col("text")), provider, "facts")
    # at most ``most`` rows of facts a document
    joined = facts.groupBy("doc_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.when(F.col("facts").isNotNull(), F.struct("no", F.concat(source, "facts").alias("b"), "pages")))).alias("x"), F.array_distinct(F.flatten(F.collect_list("warnings"))).alias("before"))
    joined = joined.withColumn("body", F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda r: r["b"]), RULE)))
    capped = F.when(F.col("total") > most, F.concat(F.lit("only the first "), F.lit(str(most)), F.lit(" of "), F.col("total").cast("string"), F.lit(" parts were summarised")))
    made = asked(joined, prompt("reduce", "Write one summary and cite the pages.", F.col("body")), provider, "summary")
    made = made.select("doc_id", "summary", F.lit("map_reduce").alias("kind"), F.size("x").cast("bigint").alias("parts"), F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda r: r["pages"])))).alias("pages"), F.array_compact(F.concat("before", "warnings", F.array(capped))).alias("warnings"))
    return whole.unionByName(made).select("doc_id", "summary", F.when(F.col("summary").isNull(), "extractive").otherwise(F.col("kind")).alias("method"), "parts", "pages", "warnings")


def window_questions(docs: DataFrame, text: str, provider: Provider) -> DataFrame:
    """``doc_id, window_index, pos, question`` that the model names in the first windows of a text: a list in an object, else the reply's lines."""
    cut = chunking.char_windows(docs.where(F.col(text).isNotNull()).select("doc_id", text), text).where(F.col("window_index") < MOST_WINDOWS)
    rows = asked(cut, prompt("questions", 'Answer with an object: "questions", a list.', F.col("window")), provider)
    body = F.regexp_extract("reply", r'(?s)\{.*?"questions".*?\}', 0)
    listed = F.from_json(body, "questions array<string>")["questions"]
    lines = F.filter(F.split("reply", "\n"), lambda x: ~T.strip(x).startswith("[") & ~T.strip(x).startswith("{"))
    found = F.filter(F.transform(F.coalesce(listed, lines), T.strip), lambda q: F.length(q) >= questions.LEAST)
    return rows.select("doc_id", F.col("window_index").cast("bigint").alias("window_index"), F.posexplode(found).alias("pos", "question")).withColumn("pos", F.col("pos").cast("bigint"))


def all_questions(docs: DataFrame, text: str, provider: Provider) -> DataFrame:
    """``doc_id, questions, method``: the model's questions before those of the patterns, cleaned, near-duplicates removed, capped."""
    model = window_questions(docs, text, provider).select("doc_id", (F.col("window_index") * 10_000 + F.col("pos")).alias("pos"), T.clean_question(F.col("question")).alias("question"))
    model = model.where(~questions.is_answer_option(F.col("question")) & (F.length("question") >= questions.LEAST))
    regex = questions.extract(docs, text).select("doc_id", (F.col("pos") + 10**9).alias("pos"), "question")
    kept = questions.greedy_distinct(model.unionByName(regex))
    seen = model.select("doc_id", F.lit("m").alias("k")).unionByName(regex.select("doc_id", F.lit("r").alias("k"))).groupBy("doc_id").agg(F.count_if(F.col("k") == "m").alias("m"), F.count_if(F.col("k") == "r").alias("r"))
    return kept.join(seen, "doc_id").select("doc_id", "questions", F.when(F.col("m") == 0, "regex").when(F.col("r") == 0, "model").otherwise("hybrid").alias("method"))


def fields_of(domain: Column) -> Column:
    table = F.create_map(*(x for k, v in FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.element_at(table, classify.domain_schema(domain))


def extracted(docs: DataFrame, text: str, domain: str, provider: Provider) -> DataFrame:
    """``doc_id, fields, method``: the fields of the domain that the model found, or dates, amounts, percentages and addresses by pattern where it found none."""
    base = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), fields_of(F.col(domain)).alias("wanted"))
    rows = asked(base, F.concat(F.lit("Task: fields. Answer with an object of these: "), F.array_join("wanted", ", "), F.lit(TEXT), F.left("text", F.lit(EXTRACT_CHARS))), provider)
    rows = rows.withColumn("fields", kept_fields(reply_object(F.col("reply")), F.col("wanted")))
    some = F.coalesce(F.size("fields") > 0, F.lit(False))
    plain = reports.entities(base, "text")
    names = [n for n, _, _ in reports.ENTITIES]
    pattern = F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.to_json(n)))), lambda k, v: v != "[]")
    return rows.join(plain, "doc_id").select("doc_id", F.when(some, F.col("fields")).otherwise(pattern).alias("fields"), F.when(some, "model").otherwise("regex").alias("method"))


def answered(asked_: DataFrame, contexts: DataFrame, provider: Provider, several: bool) -> DataFrame:
    """``q_id, reply, error``: the answer of a model to ``question`` from ``context`` alone. A question without context, or a call that fails, gets an error, never a guess."""
    order = "Answer from the passages alone and name the page of every fact. Say so if they hold no answer." + (" The passages are from several documents: name the document too, do not add up figures of different documents, and do not put one in place of another." if several else "")
    rows = asked_.join(contexts, "q_id", "left")
    body = F.concat(F.lit(f"Task: answer. {order} Question: "), "question", F.lit(TEXT), "context")
    rows = asked(rows, body, provider)
    return rows.select("q_id", "reply", F.when(F.col("reply").isNull(), F.coalesce(F.get("warnings", F.lit(0)), F.when(F.col("context").isNull(), "no context").otherwise("no reply"))).alias("error"))
