"""Queries of the stages that ask a model, on the rehearsed provider, whose replies SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafstack.functions import text as T
from leafstack.operators import classify, models
from leafstack.plans.base import query
from leafstack.plans.documents import CHUNKS, FORMS, SP, chunk_rows, forms
from leafstack.plans.retrieval import CORPUS, QUESTIONS, asked, corpus_selection
from leafstack.operators import retrieval
from leafstack.providers import Rehearsed
from leafstack.session import read_table as read

STRIP = lambda c: f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


@query(f"WITH h AS ({classify.score_sql(FORMS)}), f AS (SELECT doc_id, length(left(form, 3000)) AS n FROM ({FORMS})), m AS (SELECT doc_id, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 2 = 1 THEN (n % 100) / 100.0::DOUBLE ELSE 1 - (n % 100) / 100.0::DOUBLE END AS model FROM f), p AS (SELECT doc_id, model, CASE WHEN model IS NULL OR score >= 0.85 THEN score ELSE 0.7 * model + 0.3 * score END AS p FROM m JOIN h USING (doc_id)) SELECT doc_id, round(p, 6) AS probability, CASE WHEN p >= 0.35 THEN 'questionnaire' ELSE 'normal_document' END AS doc_type, CASE WHEN model IS NULL THEN 'General' ELSE 'Legal' END AS domain, CASE WHEN model IS NULL THEN 'heuristic' ELSE 'model' END AS method, CASE WHEN model IS NULL THEN ['reply of the model discarded'] ELSE [] END AS warnings FROM p")
def model_classify(spark, root):
    return models.classified(forms(spark, root), "form", Rehearsed())


PARTS = f"SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS r, length(text) AS n, [coalesce(page_no, 0)] AS pages FROM ({CHUNKS}) WHERE {STRIP('text')} <> ''"


@query(f"""WITH p AS ({PARTS}),
 one AS (SELECT doc_id, n, 'single' AS kind, 1 AS parts, pages, [] AS extra FROM p WHERE total = 1),
 fact AS (SELECT doc_id, total, r, pages, '[Source: Pages ' || pages[1] || ']' || chr(10) || n || ' characters.' AS b, n % 11 = 0 AS gone FROM p WHERE total > 1 AND r <= 20),
 many AS (SELECT doc_id, length(string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) FILTER (NOT gone)) AS n, 'map_reduce' AS kind, count(*) FILTER (NOT gone) AS parts, list_sort(coalesce(list(DISTINCT pages[1]) FILTER (NOT gone), [])) AS pages, CASE WHEN max(total) > 20 THEN ['only the first 20 of ' || max(total) || ' parts were summarised'] ELSE [] END AS extra FROM fact GROUP BY doc_id)
 SELECT doc_id, CASE WHEN n % 13 <> 0 THEN 'Summary of ' || n || ' characters.' END AS summary, CASE WHEN n % 13 <> 0 THEN kind ELSE 'extractive' END AS method, parts, pages, list_concat(CASE WHEN n % 13 <> 0 AND n % 5 = 0 THEN ['reply cut at the token limit'] ELSE [] END, extra) AS warnings FROM (SELECT * FROM one UNION ALL SELECT * FROM many)""")
def model_summary(spark, root):
    parts = chunk_rows(spark, root).where(T.strip(F.col("text")) != "").select("doc_id", F.col("chunk_index").alias("no"), "text", F.array(F.coalesce("page_no", F.lit(0))).alias("pages"))
    return models.summarised(parts, Rehearsed())


WINDOWS = "SELECT doc_id, i AS window_index, length(substring(full_text, i * 4800 + 1, 5000)) AS n FROM parsed_documents, range(0, CASE WHEN length(full_text) <= 5000 THEN 1 ELSE ceil((length(full_text) - 5000) / 4800.0)::BIGINT + 1 END) r(i) WHERE full_text IS NOT NULL AND i < 20"


@query(f"SELECT doc_id, window_index, p - 1 AS pos, q[p] AS question FROM (SELECT *, CASE WHEN n % 3 <> 0 THEN ['What is ' || n || '?', 'Why ' || n || '?'] ELSE ['What about ' || n || '?', 'When was ' || n || '?'] END AS q FROM ({WINDOWS})), range(1, 3) t(p)")
def model_questions(spark, root):
    return models.window_questions(read(spark, root, "parsed_documents"), "full_text", Rehearsed())


@query("SELECT doc_id, CASE WHEN n % 4 = 0 THEN 'regex' WHEN legal OR general THEN 'model' ELSE 'regex' END AS method, CASE WHEN n % 4 <> 0 AND legal THEN 'p' || n WHEN n % 4 <> 0 AND general THEN n::VARCHAR END AS found FROM (SELECT doc_id, length(left(coalesce(text, ''), 8000)) AS n, d IN ('Legal', 'Government') AS legal, d NOT IN ('Legal', 'Government', 'Financial', 'Research') AS general FROM (SELECT doc_id, text, ['Legal', 'Financial', 'Technical', 'Research', 'Government'][doc_id % 5 + 1] AS d FROM documents))")
def model_fields(spark, root):
    domain = F.element_at(F.array(*map(F.lit, ("Legal", "Financial", "Technical", "Research", "Government"))), (F.col("doc_id") % 5 + 1).cast("int"))
    made = models.extracted(read(spark, root, "documents").withColumn("domain", domain), "text", "domain", Rehearsed())
    found = F.coalesce(F.try_element_at("fields", F.lit("parties")), F.try_element_at("fields", F.lit("dates")))
    return made.select("doc_id", "method", F.when(F.col("method") == "model", found).alias("found"))


@query(f"WITH c AS (SELECT q_id, length(string_agg('[' || label || ']' || chr(10) || passage, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS n FROM (SELECT *, sum(length(label) + 3 + length(passage) + 5) OVER (PARTITION BY q_id ORDER BY rank) AS total FROM ({CORPUS})) WHERE rank = 1 OR total <= 6000 GROUP BY q_id) SELECT q_id, n || ' characters on page ' || (n % 9) || '.' AS reply, CASE WHEN n IS NULL THEN 'no context' END AS error FROM ({QUESTIONS}) LEFT JOIN c USING (q_id)")
def model_answer(spark, root):
    return models.answered(asked(spark, root), retrieval.labelled_context(corpus_selection(spark, root)), Rehearsed(), True)
