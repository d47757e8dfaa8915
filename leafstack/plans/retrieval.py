"""Queries of retrieval, chat context and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from leafstack.functions import text as T
from leafstack.operators import chunking, evaluate, retrieval
from leafstack.plans.base import query
from leafstack.plans.documents import CHUNKS, TOKENS, chunk_rows
from leafstack.session import materialize, read_table as read

#: Questions asked: the first question of every result whose id is divisible by 50 (all results that have one), or else the file name.
QUESTIONS = "SELECT result_id AS q_id, coalesce(max(questions[1]), max(file_name)) AS question FROM pipeline_results WHERE result_id % 50 = 0 GROUP BY result_id"
PASSAGES = f"SELECT doc_id * 1000000 + chunk_index * 1000 AS passage_id, doc_id, document, page_no, sheet_name, text AS passage FROM ({CHUNKS}) WHERE text IS NOT NULL"
SCORED = f"SELECT q_id, passage_id, count(*) AS score FROM (SELECT q_id, unnest({TOKENS('question')}) AS token FROM ({QUESTIONS})) JOIN (SELECT passage_id, unnest({TOKENS('passage')}) AS token FROM ({PASSAGES})) USING (token) GROUP BY q_id, passage_id"
LABEL = "CASE WHEN coalesce(document, '') <> '' THEN document || ', ' ELSE '' END || CASE WHEN page_no IS NOT NULL THEN 'Page ' || page_no WHEN coalesce(sheet_name, '') <> '' THEN 'Sheet: ' || sheet_name ELSE 'Unknown source' END"
FULL = f"SELECT s.q_id, s.score, s.passage_id AS pos, p.doc_id, p.passage, {LABEL} AS label FROM ({SCORED}) s JOIN ({PASSAGES}) p USING (passage_id)"
#: Selection by its rules, over every pair of a question and a passage of its scope. ``q``: q_id, scope; ``p``: scope, pos, label, passage; ``s``: q_id, pos, score.


def select_sql(q: str, p: str, s: str, slots: int, anchors: bool) -> str:
    return f"""WITH q AS ({q}), p AS ({p}), s AS ({s}),
 a AS (SELECT q.q_id, p.scope, p.pos, p.label, p.passage, coalesce(s.score, 0) AS score, max(coalesce(s.score, 0)) OVER (PARTITION BY q.q_id) > 0 AS matched, row_number() OVER (PARTITION BY q.q_id ORDER BY p.pos) AS n, row_number() OVER (PARTITION BY q.q_id ORDER BY p.pos DESC) AS m FROM q JOIN p USING (scope) LEFT JOIN s ON s.q_id = q.q_id AND s.pos = p.pos),
 b AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY score DESC, pos) AS own FROM a),
 c AS (SELECT *, CASE WHEN own = 1 THEN row_number() OVER (PARTITION BY q_id, own ORDER BY score DESC, pos) END AS r FROM b),
 d AS (SELECT *, CASE WHEN matched THEN coalesce(r <= {slots}, false) ELSE n <= 3 END AS ranked FROM c),
 e AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY NOT ranked, CASE WHEN ranked AND matched THEN r ELSE 0 END, pos) AS rank FROM d WHERE ranked OR ({str(anchors).lower()} AND matched AND (n = 1 OR m = 1))),
 f AS (SELECT *, sum(length(passage)) OVER (PARTITION BY q_id ORDER BY rank) AS running FROM e),
 g AS (SELECT *, NOT matched OR running <= 6000 AS kept FROM f)
 SELECT q_id, pos, label, passage, score, rank, ranked, running FROM g WHERE kept UNION ALL
 SELECT q_id, pos, label, passage, 0, 1, true, length(passage) FROM d WHERE n = 1 AND q_id NOT IN (SELECT q_id FROM g WHERE kept)"""


TOPK = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, pos) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY score DESC, pos) AS r FROM ({FULL})) WHERE r = 1) WHERE rank <= 6"
CORPUS = select_sql(f"SELECT q_id, 0 AS scope FROM ({QUESTIONS})", f"SELECT 0 AS scope, passage_id AS pos, {LABEL} AS label, passage FROM ({PASSAGES})", f"SELECT q_id, passage_id AS pos, score FROM ({SCORED})", 6, False)
#: The same questions, each put to its own document.
OWN = "SELECT result_id AS q_id, min(doc_id) AS scope FROM pipeline_results WHERE result_id % 50 = 0 AND doc_id IS NOT NULL GROUP BY result_id"
SINGLE = select_sql(OWN, f"SELECT doc_id AS scope, passage_id AS pos, {LABEL.split('END || ', 1)[1]} AS label, passage FROM ({PASSAGES})", f"SELECT q_id, passage_id AS pos, score FROM ({SCORED}) JOIN ({PASSAGES}) USING (passage_id) JOIN ({OWN}) USING (q_id) WHERE doc_id = scope", 3, True)
#: The expected sources of a question: the documents it was taken from.
EXPECTED = "SELECT result_id AS q_id, list_sort(list(DISTINCT doc_id)) AS expected FROM pipeline_results WHERE result_id % 50 = 0 AND doc_id IS NOT NULL GROUP BY result_id"


def asked(spark, root):
    rows = read(spark, root, "pipeline_results").where("result_id % 50 = 0")
    return rows.groupBy(F.col("result_id").alias("q_id")).agg(F.coalesce(F.max(F.get("questions", F.lit(0))), F.max("file_name")).alias("question"))


def held(spark, root):
    rows = chunk_rows(spark, root).where("text IS NOT NULL")
    return rows.select((F.col("doc_id") * 1000000 + F.col("chunk_index") * 1000).alias("passage_id"), "doc_id", T.source_label(F.col("document"), F.col("page_no"), F.col("sheet_name")).alias("label"), F.col("text").alias("passage"))


def scored(spark, root):
    p = held(spark, root)
    return retrieval.keyword_scores(asked(spark, root), p).join(p, "passage_id").withColumnRenamed("passage_id", "pos")


def top(spark, root):
    return retrieval.distinct_sources(scored(spark, root), ["label"])


def corpus_selection(spark, root):
    p = materialize(held(spark, root), "passages")
    keys = p.select(F.lit(0).alias("scope"), F.col("passage_id").alias("pos"), F.col("label").alias("source"), F.length("passage").alias("size"))
    hit = retrieval.keyword_scores(asked(spark, root), p).withColumnRenamed("passage_id", "pos")
    chosen = retrieval.select_context(hit, keys, asked(spark, root).select("q_id", F.lit(0).alias("scope")), retrieval.SLOTS, False)
    return chosen.withColumnRenamed("source", "label").join(p.select(F.col("passage_id").alias("pos"), "doc_id", "passage"), "pos")


def document_selection(spark, root):
    p = chunk_rows(spark, root).where("text IS NOT NULL").select((F.col("doc_id") * 1000000 + F.col("chunk_index") * 1000).alias("passage_id"), F.col("doc_id").alias("scope"), T.source_label(F.lit(None), F.col("page_no"), F.col("sheet_name")).alias("label"), F.col("text").alias("passage"))
    own = read(spark, root, "pipeline_results").where("result_id % 50 = 0 AND doc_id IS NOT NULL").groupBy(F.col("result_id").alias("q_id")).agg(F.min("doc_id").alias("scope"))
    p = materialize(p.join(own.select("scope").distinct(), "scope", "left_semi"), "passages")
    hit = retrieval.keyword_scores(asked(spark, root), p).join(p.select("passage_id", "scope"), "passage_id").join(own, ["q_id", "scope"], "left_semi").withColumnRenamed("passage_id", "pos")
    keys = p.select("scope", F.col("passage_id").alias("pos"), F.col("label").alias("source"), F.length("passage").alias("size"))
    chosen = retrieval.select_context(hit, keys, own, retrieval.SINGLE_SLOTS, True)
    return chosen.withColumnRenamed("source", "label").join(p.select(F.col("passage_id").alias("pos"), "passage"), "pos")


def expected(spark, root):
    return read(spark, root, "pipeline_results").where("result_id % 50 = 0 AND doc_id IS NOT NULL").groupBy(F.col("result_id").alias("q_id")).agg(F.sort_array(F.collect_set("doc_id")).alias("expected"))


@query(SCORED)
def keyword_retrieve(spark, root):
    return retrieval.keyword_scores(asked(spark, root), held(spark, root))


@query("SELECT q_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS q_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE rank <= 10")
def vector_retrieve(spark, root):
    v = read(spark, root, "embeddings").select("vec_id", "embedding")
    asking = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id")
    return retrieval.vector_top(asking, v, 10).select("q_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT q_id, pos, label, score, rank FROM ({CORPUS}) WHERE ranked")
def retrieve_topk(spark, root):
    return corpus_selection(spark, root).where("ranked").select("q_id", "pos", "label", "score", "rank")


@query(f"SELECT q_id, pos, rank, running FROM ({CORPUS})")
def context_budget(spark, root):
    return corpus_selection(spark, root).select("q_id", "pos", "rank", "running")


@query(f"SELECT q_id, pos, label, score, rank, ranked, running FROM ({SINGLE})")
def document_context(spark, root):
    """One document: three sources, its first and last passage, the budget."""
    return document_selection(spark, root).select("q_id", "pos", "label", "score", "rank", "ranked", "running")


@query(f"SELECT q_id, string_agg('[' || label || ']' || chr(10) || passage, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT *, sum(length(label) + 3 + length(passage) + 5) OVER (PARTITION BY q_id ORDER BY rank) AS total FROM ({CORPUS})) WHERE rank = 1 OR total <= 6000 GROUP BY q_id")
def format_context(spark, root):
    return retrieval.labelled_context(corpus_selection(spark, root))


CITABLE = "label <> 'Unknown source' AND NOT label LIKE '%, Unknown source'"


@query(f"SELECT q_id, coalesce(string_agg(label, '; ' ORDER BY rank) FILTER ({CITABLE}), '') AS sources, coalesce(string_agg(regexp_replace(label, '^.*, (Page |Sheet: )', '\\1'), '; ' ORDER BY rank) FILTER ({CITABLE}), '') AS bare, count(*) FILTER ({CITABLE}) AS n FROM ({CORPUS}) WHERE ranked GROUP BY q_id")
def citations(spark, root):
    return retrieval.citable(corpus_selection(spark, root))


@query(f"SELECT q_id, list_sort(list(DISTINCT pos // 1000000)) AS documents FROM ({CORPUS}) GROUP BY q_id")
def documents_searched(spark, root):
    return corpus_selection(spark, root).groupBy("q_id").agg(F.sort_array(F.collect_set(F.floor(F.col("pos") / 1000000))).alias("documents"))


@query(f"SELECT doc_id, min(chunk_index) AS first_chunk, max(chunk_index) AS last_chunk FROM ({CHUNKS}) GROUP BY doc_id")
def anchors(spark, root):
    return chunk_rows(spark, root).groupBy("doc_id").agg(F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"))


@query(f"SELECT doc_id, chunk_index, {LABEL} AS label FROM ({CHUNKS})")
def source_label(spark, root):
    return chunk_rows(spark, root).select("doc_id", "chunk_index", T.source_label(F.col("document"), F.col("page_no"), F.col("sheet_name")).alias("label"))


@query(f"SELECT q_id, doc_id, max(score) AS best FROM ({FULL}) GROUP BY q_id, doc_id")
def best_per_source(spark, root):
    return scored(spark, root).groupBy("q_id", "doc_id").agg(F.max("score").alias("best"))


RANKS = f"SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY best DESC, first_pos) AS rank, best FROM (SELECT q_id, doc_id, max(score) AS best, min(pos) AS first_pos FROM ({FULL}) GROUP BY q_id, doc_id)"


@query(f"SELECT e.q_id, coalesce(min(r.rank), 0) AS any_rank, CASE WHEN count(r.rank) = max(len(expected)) THEN max(r.rank) ELSE 0 END AS all_rank FROM ({EXPECTED}) e LEFT JOIN ({RANKS}) r ON r.q_id = e.q_id AND list_contains(e.expected, r.doc_id) GROUP BY e.q_id")
def answer_rank(spark, root):
    return evaluate.answer_ranks(scored(spark, root), expected(spark, root))


@query(f"SELECT e.q_id, coalesce(list_has_any(expected, docs), false) AS any_hit, coalesce(list_has_all(docs, expected), false) AS all_hit FROM ({EXPECTED}) e LEFT JOIN (SELECT q_id, list(DISTINCT doc_id) AS docs FROM ({TOPK}) GROUP BY q_id) t USING (q_id)")
def retrieval_hit(spark, root):
    return evaluate.hits(top(spark, root), expected(spark, root))


@query(f"SELECT e.q_id, CASE WHEN max(CASE WHEN list_contains(expected, doc_id) THEN best END) IS NULL THEN 'miss' WHEN max(CASE WHEN list_contains(expected, doc_id) THEN best END) > coalesce(max(CASE WHEN NOT list_contains(expected, doc_id) THEN best END), -1) THEN 'ranked' ELSE 'incidental' END AS kind FROM ({EXPECTED}) e LEFT JOIN (SELECT q_id, doc_id, max(score) AS best FROM ({FULL}) GROUP BY q_id, doc_id) b USING (q_id) GROUP BY e.q_id")
def hit_kind(spark, root):
    return evaluate.hit_kinds(scored(spark, root), expected(spark, root))


@query(f"SELECT q_id, bare, count(*) AS losers FROM (SELECT q_id, bare, doc_id, first_value(doc_id) OVER (PARTITION BY q_id, bare ORDER BY score DESC, pos) AS winner FROM (SELECT s.q_id, s.score, s.passage_id AS pos, p.doc_id, CASE WHEN page_no IS NOT NULL THEN 'Page ' || page_no WHEN coalesce(sheet_name, '') <> '' THEN 'Sheet: ' || sheet_name ELSE 'Unknown source' END AS bare FROM ({SCORED}) s JOIN ({PASSAGES}) p USING (passage_id))) WHERE doc_id <> winner GROUP BY q_id, bare")
def label_collisions(spark, root):
    rows = chunk_rows(spark, root).where("text IS NOT NULL").select((F.col("doc_id") * 1000000 + F.col("chunk_index") * 1000).alias("passage_id"), "doc_id", T.source_label(F.lit(None), F.col("page_no"), F.col("sheet_name")).alias("bare"), F.col("text").alias("passage"))
    s = retrieval.keyword_scores(asked(spark, root), rows).join(rows.drop("passage"), "passage_id").withColumnRenamed("passage_id", "pos")
    return evaluate.collisions(s, "bare")


@query(f"SELECT label, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, {LABEL.split('END || ', 1)[1]} AS label FROM ({CHUNKS})) GROUP BY label HAVING count(DISTINCT doc_id) > 1")
def ambiguous_labels(spark, root):
    rows = chunk_rows(spark, root).select("doc_id", T.source_label(F.lit(None), F.col("page_no"), F.col("sheet_name")).alias("label")).distinct()
    return rows.groupBy("label").agg(F.count("*").alias("documents")).where("documents > 1")


@query("SELECT summary_method, file_type, count(*) AS cases, count_if(success) AS hits, round(avg(len(questions)), 6) AS mean_questions FROM (SELECT DISTINCT result_id, summary_method, file_type, success, questions FROM pipeline_results) GROUP BY ROLLUP (summary_method, file_type)")
def eval_rollup(spark, root):
    rows = read(spark, root, "pipeline_results").select("result_id", "summary_method", "file_type", "success", "questions").distinct()
    return evaluate.roll_up(rows)


@query(f"SELECT least(a.q, b.q) AS q_a, greatest(a.q, b.q) AS q_b, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM (SELECT DISTINCT norm AS q, list_distinct(string_split(norm, ' ')) AS t FROM (SELECT regexp_replace(regexp_replace(lower(trim(unnest(questions))), '[?. ]+$', ''), ' +', ' ', 'g') AS norm FROM pipeline_results)) a JOIN (SELECT DISTINCT norm AS q, list_distinct(string_split(norm, ' ')) AS t FROM (SELECT regexp_replace(regexp_replace(lower(trim(unnest(questions))), '[?. ]+$', ''), ' +', ' ', 'g') AS norm FROM pipeline_results)) b ON a.q < b.q WHERE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.5")
def jaccard_pairs(spark, root):
    rows = read(spark, root, "pipeline_results").select(F.explode("questions").alias("q")).select(F.regexp_replace(F.regexp_replace(F.lower(F.trim("q")), "[?. ]+$", ""), " +", " ").alias("q")).distinct()
    return evaluate.similar_sets(rows.select("q", F.array_distinct(F.split("q", " ")).alias("t")), 0.5)


#: The events of a user as a conversation, in the order of their ids.
TURNS = "SELECT user_id AS conv_id, event_id AS turn, length(props) * 400 AS chars, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events"


@query(f"SELECT conv_id, turn FROM (SELECT *, sum(chars) OVER (PARTITION BY conv_id) AS total, sum(CASE WHEN r > 2 THEN chars ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS suffix FROM ({TURNS})) WHERE total / 4.0 <= 20000 OR r <= 2 OR suffix / 4.0 <= 20000")
def history_truncate(spark, root):
    turns = read(spark, root, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), (F.length("props") * 400).alias("chars"))
    return evaluate.truncate_history(turns).select("conv_id", "turn")


@query("SELECT p.doc_id, count(*) AS slices, string_agg('[Source: Page ' || coalesce(page_no, 0) || ']', ' ' ORDER BY chunk_index) AS tagged FROM (" + CHUNKS + ") p WHERE text IS NOT NULL GROUP BY p.doc_id")
def tag_sources(spark, root):
    rows = chunk_rows(spark, root).where("text IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("slices"), F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("page_no", F.lit(0)).alias("page")))).alias("c"))
    return rows.select("doc_id", "slices", F.array_join(F.transform("c", lambda x: F.concat(F.lit("[Source: Page "), x["page"].cast("string"), F.lit("]"))), " ").alias("tagged"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS stored FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM review_labels) l USING (doc_id)")
def gap_fill(spark, root):
    docs, stored = read(spark, root, "documents").select("doc_id").distinct(), read(spark, root, "review_labels").select("doc_id").distinct()
    gaps = docs.join(stored, "doc_id", "left_anti").withColumn("stored", F.lit(False))
    return docs.join(stored, "doc_id", "left_semi").withColumn("stored", F.lit(True)).unionByName(gaps)
