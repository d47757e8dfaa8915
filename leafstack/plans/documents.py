"""Queries over the texts of documents, chunks and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from leafstack.functions import text as T
from leafstack.operators import chunking, classify, questions, reports, summarize, tables
from leafstack.plans.base import SQL, query
from leafstack.session import read_table as read, spread

SP = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = lambda c: f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"
WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '{SP}+'), lambda x: x <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS) + "]"
STOP2 = "[" + ", ".join(f"'{w}'" for w in T.SENTENCE_STOPWORDS) + "]"
RAW_TOKENS = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
TOKENS = lambda c: f"list_filter(list_distinct({RAW_TOKENS(c)}), lambda x: regexp_full_match(x, '[a-z]{{3,}}|[a-z]+[0-9]+') AND NOT list_contains({STOP}, x))"
TERMS = lambda c: f"list_filter({RAW_TOKENS(c)}, lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains({STOP2}, x))"
#: Chunks without the rows that were delivered twice.
CHUNKS = "SELECT doc_id, chunk_index, document, page_no, sheet_name, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY text DESC NULLS LAST, page_no DESC NULLS LAST, sheet_name DESC NULLS LAST, document DESC NULLS LAST) AS nth FROM chunks) WHERE nth = 1"
#: The whole text of every document, followed by a form with numbered questions, options and fields built from its columns, and one of SIGNS in turn.
SIGNS = ("Net promoter score: how likely are you", "Somewhat agree", "Rate your visit, rating: 3", "Check all that apply", "Answer here: _____ [   ]", "Optional: *", "Yes or No", "I consent and I agree", "Date: ____ dd/mm/yyyy", "Instructions: how to complete", "☐ one ☑ two", "Feedback", "1. describe the state", "(a) first")
FORM = "coalesce(text, '') || chr(10) || 'Customer survey ' || doc_id || chr(10) || 'Q1. How often do you visit ' || coalesce(source, 'us') || '?' || chr(10) || '2) Please describe problem ' || (doc_id % 7) || ' in detail' || chr(10) || 'a) Yes' || chr(10) || 'b) No' || chr(10) || 'How satisfied are you with ' || coalesce(source, 'us') || '?' || chr(10) || 'We would like to know more about' || chr(10) || 'your plans for ' || (doc_id % 5) || '?' || chr(10) || '**What is item ' || (doc_id % 3) || '?**' || chr(10) || 'First Name: ____' || chr(10) || '3. what is required (required)' || chr(10) || 'Page ' || doc_id || ' of 9' || chr(10) || '[ ] agree' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Strongly agree' ELSE 'Comments:' END || chr(10) || 'written on ' || (doc_id % 28 + 1) || '/03/2024 for $' || (doc_id % 90) || '.50 million at ' || (doc_id % 100) || '% by a' || doc_id || '@mail.org' || chr(10) || [" + ", ".join(f"'{x}'" for x in SIGNS) + "][doc_id % 14 + 1]"


def chunk_rows(spark: SparkSession, root: str) -> DataFrame:
    """Chunks without the rows that were delivered twice: one whole row each, the one with the greatest text where they differ."""
    one = F.max(F.struct("text", "page_no", "sheet_name", "document")).alias("r")
    return read(spark, root, "chunks").groupBy("doc_id", "chunk_index").agg(one).select("doc_id", "chunk_index", "r.document", "r.page_no", "r.sheet_name", "r.text")


def forms(spark: SparkSession, root: str) -> DataFrame:
    c = lambda x: F.lit(x)
    d, s = F.col("doc_id"), F.coalesce("source", F.lit("us"))
    n = lambda m: (d % m).cast("string")
    form = F.concat(F.coalesce("text", c("")), c("\nCustomer survey "), d, c("\nQ1. How often do you visit "), s, c("?\n2) Please describe problem "), n(7), c(" in detail\na) Yes\nb) No\nHow satisfied are you with "), s, c("?\nWe would like to know more about\nyour plans for "), n(5), c("?\n**What is item "), n(3), c("?**\nFirst Name: ____\n3. what is required (required)\nPage "), d, c(" of 9\n[ ] agree\n"), F.when(d % 2 == 0, "Strongly agree").otherwise("Comments:"), c("\nwritten on "), (d % 28 + 1).cast("string"), c("/03/2024 for $"), n(90), c(".50 million at "), n(100), c("% by a"), d, c("@mail.org\n"), F.element_at(F.array(*map(c, SIGNS)), (d % len(SIGNS) + 1).cast("int")))
    return spread(read(spark, root, "documents").select("doc_id", "source", "text")).select("doc_id", "source", form.alias("form"))


FORMS = f"SELECT doc_id, source, {FORM} AS form FROM documents"


@query(f"SELECT doc_id, len({WORDS('full_text')}) AS words, length(full_text) AS chars, {STRIP('full_text')} = '' AS is_empty FROM parsed_documents WHERE full_text IS NOT NULL")
def doc_stats(spark, root):
    t = F.col("full_text")
    return read(spark, root, "parsed_documents").where(t.isNotNull()).select("doc_id", T.word_count(t).alias("words"), F.length(t).alias("chars"), (T.strip(t) == "").alias("is_empty"))


DIRTY = "chr(13) || chr(10) || 'Page ' || doc_id || ' of 99' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || ' • ' || chr(10) || '3 / 9' || chr(10) || 'tail'"


def clean_sql(c: str) -> str:
    t = f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '(?im)^[ \t]*(page[ \t]*[0-9]+([ \t]+of[ \t]+[0-9]+)?|[0-9]+[ \t]*/[ \t]*[0-9]+)[ \t]*$', '', 'g')"
    t = rf"regexp_replace({t}, '(?m)^[ \t]*[-•◦▪·][ \t]*$', '', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return STRIP(rf"regexp_replace({t}, '(?m)[ \t]+$', '', 'g')")


@query(f"SELECT doc_id, chunk_index, {clean_sql(DIRTY)} AS cleaned FROM ({CHUNKS}) WHERE text IS NOT NULL")
def text_clean(spark, root):
    dirty = F.concat(F.lit("\r\nPage "), "doc_id", F.lit(" of 99\n"), "text", F.lit("\n\n\n\n • \n3 / 9\ntail"))
    return chunk_rows(spark, root).where("text IS NOT NULL").select("doc_id", "chunk_index", T.clean(dirty).alias("cleaned"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(replace(form, ' ', '   '), ' {{3,}}', '  ', 'g'), '\n[ \t]*\n', chr(10), 'g') AS squeezed FROM ({FORMS})")
def layout_squeeze(spark, root):
    return forms(spark, root).select("doc_id", T.squeeze_layout(F.replace("form", F.lit(" "), F.lit("   "))).alias("squeezed"))


@query(f"SELECT doc_id, list_sort({TOKENS('text')}) AS tokens FROM documents WHERE text IS NOT NULL")
def tokenize(spark, root):
    return read(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.sort_array(T.content_tokens(F.col("text"))).alias("tokens"))


@query(f"SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP('x')}), lambda x: length(x) > 25) AS s FROM documents WHERE text IS NOT NULL), range(1, len(s) + 1) r(i)")
def sentences(spark, root):
    return read(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TERMS('text')}) AS term FROM documents) GROUP BY doc_id, term")
def term_freq(spark, root):
    return read(spark, root, "documents").select("doc_id", F.explode(T.term_list(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP('x')}), lambda x: length(x) > 25) AS ss FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, i - 1 AS idx, ss[i] AS sent, len(ss) AS total FROM s, range(1, len(ss) + 1) r(i)),
f AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TERMS('text')}) AS term FROM documents) GROUP BY doc_id, term),
w AS (SELECT doc_id, idx, unnest({TERMS('sent')}) AS term FROM e),
t AS (SELECT w.doc_id, w.idx, sum(f.n) AS hits, count(*) AS k FROM w JOIN f USING (doc_id, term) GROUP BY w.doc_id, w.idx),
sc AS (SELECT e.*, round(coalesce(hits, 0)::DOUBLE / (coalesce(k, 0) + 1) * CASE WHEN idx::DOUBLE / total < 0.1 OR idx::DOUBLE / total > 0.9 THEN 1.2 ELSE 1.0 END * CASE WHEN length(sent) > 40 AND length(sent) < 200 THEN 1.1 ELSE 0.9 END, 6) AS score FROM e LEFT JOIN t USING (doc_id, idx)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx DESC) AS rn FROM sc)
SELECT doc_id, string_agg(sent, ' ' ORDER BY idx) AS summary, count(*) AS picked FROM r WHERE rn <= 5 GROUP BY doc_id""")
def extractive_summary(spark, root):
    return summarize.extractive(read(spark, root, "documents"), 5)


@query(f"SELECT doc_id, chunk_index, pi - 1 AS passage_index, p[pi] AS passage FROM (SELECT doc_id, chunk_index, CASE WHEN len(w) <= 100 OR text IS NULL THEN [coalesce(text, '')] ELSE list_transform(range(0, ceil((len(w) - 100) / 80.0)::BIGINT + 1), lambda i: array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ')) END AS p FROM (SELECT *, {WORDS('text')} AS w FROM ({CHUNKS}))), range(1, len(p) + 1) r(pi)")
def passages(spark, root):
    return chunking.passages(chunk_rows(spark, root)).select("doc_id", "chunk_index", F.col("passage_index").cast("bigint").alias("passage_index"), "passage")


@query("SELECT doc_id, i AS window_index, substring(full_text, i * 4800 + 1, 5000) AS \"window\" FROM parsed_documents, range(0, CASE WHEN length(full_text) <= 5000 THEN 1 ELSE ceil((length(full_text) - 5000) / 4800.0)::BIGINT + 1 END) r(i) WHERE full_text IS NOT NULL")
def char_windows(spark, root):
    return chunking.char_windows(read(spark, root, "parsed_documents").where("full_text IS NOT NULL").select("doc_id", "full_text"), "full_text").withColumn("window_index", F.col("window_index").cast("bigint"))


@query("SELECT doc_id, i + 1 AS slice_no, substring(t, i * 1000 + 1, 1000) AS slice FROM (SELECT doc_id, coalesce(full_text, '') AS t FROM parsed_documents), range(0, greatest(1, ceil(length(t) / 1000.0)::BIGINT)) r(i)")
def fixed_slices(spark, root):
    return chunking.fixed_slices(read(spark, root, "parsed_documents").select("doc_id", "full_text"), "full_text").withColumn("slice_no", F.col("slice_no").cast("bigint"))


@query(f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS full_text FROM ({CHUNKS}) WHERE text <> '' GROUP BY doc_id")
def assemble_full_text(spark, root):
    rows = chunk_rows(spark, root).where("text <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return rows.select("doc_id", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("full_text"))


OFFSETS = f"SELECT *, start_at + length(text) AS end_at FROM (SELECT doc_id, chunk_index, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM ({CHUNKS}) WHERE {STRIP('text')} <> '')"


@query(f"SELECT doc_id, chunk_index, start_at, end_at FROM ({OFFSETS})")
def page_offsets(spark, root):
    return chunking.page_offsets(chunk_rows(spark, root)).select("doc_id", "chunk_index", "start_at", "end_at")


@query(f"SELECT doc_id, slice, list_sort(list(DISTINCT chunk_index)) AS pages FROM (SELECT doc_id, chunk_index, start_at, end_at, unnest(range(0, 400)) AS slice FROM ({OFFSETS})) WHERE slice * 4000 < end_at AND (slice + 1) * 4000 > start_at GROUP BY doc_id, slice")
def page_overlap(spark, root):
    return chunking.page_overlap(chunking.page_offsets(chunk_rows(spark, root))).withColumn("slice", F.col("slice").cast("bigint"))


@query()
def extractive_sections(spark, root):
    docs = read(spark, root, "documents").select("doc_id", "text")
    return summarize.by_section(docs, chunking.sections(docs, "text"))


def cut_sql(at: str, size: int = 4000, overlap: int = 300) -> str:
    """End of the chunk that starts at ``at`` (from 0) in the text ``t``."""
    last = [f"length(regexp_extract(substring(t, {at} + {overlap} + 1, {size - overlap}), '(?s)^(.*{b.replace('.', chr(92) + '.').replace('?', chr(92) + '?')})', 1))" for b in chunking.BREAKS]
    return f"CASE WHEN {at} + {size} >= length(t) THEN length(t) " + " ".join(f"WHEN {x} > 0 THEN {at} + {overlap} + {x}" for x in last) + f" ELSE {at} + {size} END"


@query(f"WITH RECURSIVE c AS (SELECT doc_id, full_text AS t, 0 AS chunk_no, 0::BIGINT AS start_at, ({cut_sql('0').replace('(t,', '(full_text,').replace('(t)', '(full_text)')})::BIGINT AS end_at FROM parsed_documents WHERE full_text <> '' UNION ALL SELECT doc_id, t, chunk_no + 1, s, ({cut_sql('s')})::BIGINT FROM (SELECT *, greatest(start_at + 1, end_at - 300) AS s FROM c WHERE end_at < length(t))) SELECT doc_id, chunk_no, start_at, end_at, substring(t, start_at + 1, end_at - start_at) AS chunk FROM c")
def boundary_chunks(spark, root):
    return chunking.boundary_chunks(read(spark, root, "parsed_documents"), "full_text")


@query()
def sections(spark, root):
    return chunking.sections(read(spark, root, "documents"), "text")


@query()
def pack_sections(spark, root):
    return chunking.section_chunks(read(spark, root, "documents"), "text")


@query(r"SELECT doc_id, count(*) AS headings, min(l) AS first_heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '^#{1,4}[ \t]+.+$|^[0-9]+(\.[0-9]+)*[ \t]{1,4}[A-Z].{2,70}$|^[A-Z][A-Z0-9 :-]{4,60}[A-Z0-9]$|^(?i:section|chapter|part|article)[ \t]+[0-9]+[:. \t]+.+$') GROUP BY doc_id")
def headings(spark, root):
    lines = read(spark, root, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    hit = F.col("l").rlike(r"(?d)^#{1,4}[ \t]+.+$|^[0-9]+(\.[0-9]+)*[ \t]{1,4}[A-Z].{2,70}$|^[A-Z][A-Z0-9 :-]{4,60}[A-Z0-9]$|^(?i:section|chapter|part|article)[ \t]+[0-9]+[:. \t]+.+$")
    return lines.where(hit).groupBy("doc_id").agg(F.count("*").alias("headings"), F.min("l").alias("first_heading"))


@query(f"SELECT doc_id, chunk_index FROM ({CHUNKS}) WHERE {STRIP('text')} <> ''")
def nonblank_chunks(spark, root):
    return chunk_rows(spark, root).where(T.strip(F.col("text")) != "").select("doc_id", "chunk_index")


@query("SELECT doc_id, left(full_text, 3000) AS classify_text, left(full_text, 8000) AS entity_text, left(full_text, 12000) AS edit_text FROM parsed_documents")
def prefix_truncate(spark, root):
    t = F.col("full_text")
    return read(spark, root, "parsed_documents").select("doc_id", F.left(t, F.lit(3000)).alias("classify_text"), F.left(t, F.lit(8000)).alias("entity_text"), F.left(t, F.lit(12000)).alias("edit_text"))


@query(rf"SELECT doc_id, chunk_index, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g'))::DOUBLE / length(text) < 0.6 OR (length(text) > 50 AND NOT contains(text, ' ')) AS garbage FROM ({CHUNKS}) WHERE text <> ''")
def garbage_text(spark, root):
    t = F.col("text")
    return chunk_rows(spark, root).where("text <> ''").select("doc_id", "chunk_index", ((F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) / F.length(t) < 0.6) | ((F.length(t) > 50) & ~t.contains(" "))).alias("garbage"))


# classification

@query(classify.score_sql(FORMS))
def heuristic_score(spark, root):
    return classify.scored(forms(spark, root), "form")


@query(f"SELECT doc_id, d AS density, CASE WHEN d > 0.008 THEN least(d * 6, 0.15) ELSE 0 END AS bonus FROM (SELECT doc_id, round((length(form) - length(replace(form, '?', '')))::DOUBLE / greatest(len({WORDS('form')}), 1), 6) AS d FROM ({FORMS}))")
def question_density(spark, root):
    d = F.round(classify.density(F.col("form")), 6)
    return forms(spark, root).select("doc_id", d.alias("density")).withColumn("bonus", F.when(F.col("density") > 0.008, F.least(F.col("density") * 6, F.lit(0.15))).otherwise(0.0))


@query("SELECT DISTINCT result_id, round(CASE WHEN lower(doc_type) = 'questionnaire' THEN coalesce(classification_confidence, 0) ELSE 1 - coalesce(classification_confidence, 0) END, 6) AS confidence FROM pipeline_results")
def verdict_confidence(spark, root):
    return read(spark, root, "pipeline_results").select("result_id", F.round(classify.verdict_confidence(F.col("classification_confidence"), F.col("doc_type")), 6).alias("confidence")).distinct()


@query("SELECT DISTINCT result_id, round(CASE WHEN h < 0.85 THEN 0.7 * p + 0.3 * h ELSE h END, 6) AS blended, CASE WHEN CASE WHEN h < 0.85 THEN 0.7 * p + 0.3 * h ELSE h END >= 0.35 THEN 'questionnaire' ELSE 'normal_document' END AS verdict FROM (SELECT result_id, coalesce(classification_confidence, 0) AS p, (result_id % 100) / 100.0 AS h FROM pipeline_results)")
def blend_score(spark, root):
    h = (F.col("result_id") % 100) / F.lit(100.0)
    b = classify.blend(F.coalesce("classification_confidence", F.lit(0.0)), h)
    return read(spark, root, "pipeline_results").select("result_id", F.round(b, 6).alias("blended"), classify.verdict(b).alias("verdict")).distinct()


@query("SELECT DISTINCT result_id, array_to_string(list_filter(['text_cleaner', 'document_classifier', CASE WHEN file_type <> 'audio' AND (coalesce(domain, 'General') IN ('Technical', 'Financial', 'Research', 'Scientific', 'Medical') OR file_type = 'excel') THEN 'structure_recognition' END, 'summarization', CASE WHEN doc_type = 'questionnaire' THEN 'question_extraction' END, CASE WHEN doc_type <> 'questionnaire' AND file_type <> 'audio' THEN 'structured_extraction' END], lambda x: x IS NOT NULL), ' → ') AS plan FROM pipeline_results")
def stage_plan(spark, root):
    return read(spark, root, "pipeline_results").select("result_id", F.array_join(classify.stage_plan(F.col("file_type"), F.col("doc_type"), F.coalesce("domain", F.lit("General")), F.col("file_type") == "excel"), " → ").alias("plan")).distinct()


@query("WITH reg AS (SELECT ['text_cleaner', 'document_classifier', 'summarization', 'question_extraction'] AS r), p AS (SELECT DISTINCT result_id, list_filter(['text_cleaner', 'document_classifier', CASE WHEN file_type <> 'audio' AND (coalesce(domain, 'General') IN ('Technical', 'Financial', 'Research', 'Scientific', 'Medical') OR file_type = 'excel') THEN 'structure_recognition' END, 'summarization', CASE WHEN doc_type = 'questionnaire' THEN 'question_extraction' END, CASE WHEN doc_type <> 'questionnaire' AND file_type <> 'audio' THEN 'structured_extraction' END], lambda x: x IS NOT NULL) AS plan FROM pipeline_results) SELECT result_id, array_to_string(list_filter(plan, lambda x: list_contains(r, x)), ',') AS kept, array_to_string(list_filter(plan, lambda x: NOT list_contains(r, x)), ',') AS skipped FROM p, reg")
def plan_registry(spark, root):
    known = F.array(*map(F.lit, ("text_cleaner", "document_classifier", "summarization", "question_extraction")))
    plan = classify.stage_plan(F.col("file_type"), F.col("doc_type"), F.coalesce("domain", F.lit("General")), F.col("file_type") == "excel")
    return read(spark, root, "pipeline_results").select("result_id", F.array_join(F.array_intersect(plan, known), ",").alias("kept"), F.array_join(F.array_except(plan, known), ",").alias("skipped")).distinct()


@query("SELECT DISTINCT result_id, coalesce(map {'Financial': 'Financial', 'Legal': 'Legal', 'Healthcare': 'Healthcare', 'Medical': 'Healthcare', 'Research': 'Research', 'Scientific': 'Research', 'Technical': 'General', 'Educational': 'General', 'Government': 'Legal', 'Environmental': 'General', 'HR': 'General'}[domain], 'General') AS field_schema FROM pipeline_results")
def domain_schema(spark, root):
    return read(spark, root, "pipeline_results").select("result_id", classify.domain_schema(F.col("domain")).alias("field_schema")).distinct()


CLEANED = f"SELECT p.doc_id, file_type, coalesce(d.domain, 'General') AS domain, {clean_sql('full_text')} AS form FROM parsed_documents p LEFT JOIN (SELECT doc_id, min(domain) AS domain FROM pipeline_results GROUP BY doc_id) d ON p.doc_id = d.doc_id"


@query(f"SELECT c.doc_id, coalesce(s.score, 0) AS score, CASE WHEN coalesce(s.score, 0) >= 0.35 THEN 'questionnaire' ELSE 'normal_document' END AS doc_type, array_to_string(list_filter(['text_cleaner', 'document_classifier', CASE WHEN file_type <> 'audio' AND (domain IN ('Technical', 'Financial', 'Research', 'Scientific', 'Medical') OR file_type = 'excel') THEN 'structure_recognition' END, 'summarization', CASE WHEN coalesce(s.score, 0) >= 0.35 THEN 'question_extraction' END, CASE WHEN coalesce(s.score, 0) < 0.35 AND file_type <> 'audio' THEN 'structured_extraction' END], lambda x: x IS NOT NULL), ',') AS plan FROM ({CLEANED}) c LEFT JOIN ({classify.score_sql(CLEANED)}) s USING (doc_id)")
def analyse(spark, root):
    """The pipeline over all parsed documents: verdict and plan of each."""
    from leafstack.registry import analyse

    domains = read(spark, root, "pipeline_results").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    made = analyse(read(spark, root, "parsed_documents").join(domains, "doc_id", "left"), domain="domain")
    return made.select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), "doc_type", F.array_join("plan", ",").alias("plan"))


# questions

def found_sql() -> str:
    """All findings of a form, in the order of the patterns, then those over two lines."""
    listed = ", ".join(f"regexp_extract_all(form, '{p.replace(chr(39), chr(39) * 2)}', {g})" for _, p, g in questions.PATTERNS)
    line = lambda i: STRIP(f"l[{i}]")
    two = f"list_transform(list_filter(range(1, len(l)::BIGINT), lambda i: regexp_matches({line('i')}, '^[A-Z]') AND NOT regexp_matches({line('i')}, '[.?!:,;]$') AND {line('i + 1')} LIKE '%?' AND length({line('i')}) > 10 AND length({line('i')} || {line('i + 1')}) < 250), lambda i: {line('i')} || ' ' || {line('i + 1')})"
    return f"SELECT doc_id, list_concat({listed}, {two}) AS q FROM (SELECT *, string_split(form, chr(10)) AS l FROM ({FORMS}))"


OPTION_SQL = questions.ANSWER.replace("'", "''")


def questions_sql() -> str:
    kept = f"list_filter(list_transform(q, lambda x: {STRIP('x')}), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '{OPTION_SQL}'))"
    cleaned = f"list_filter(list_transform({kept}, lambda x: {clean_q_sql('x')}), lambda x: length(x) >= 4)"
    return f"SELECT doc_id, i - 1 AS pos, upper(left(c[i], 1)) || substring(c[i], 2) AS question FROM (SELECT doc_id, {cleaned} AS c FROM ({found_sql()})), range(1, len(c)::BIGINT + 1) r(i)"


@query("LATER")
def question_regex(spark, root):
    return questions.extract(forms(spark, root), "form")


LINES = f"SELECT doc_id, i - 1 AS pos, {STRIP('l[i]')} AS line FROM (SELECT doc_id, string_split(form, chr(10)) AS l FROM ({FORMS})), range(1, len(l) + 1) r(i)"


@query(f"SELECT doc_id, pos, line || ' ' || nxt AS question FROM (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM ({LINES})) WHERE regexp_matches(line, '^[A-Z]') AND NOT regexp_matches(line, '[.?!:,;]$') AND nxt LIKE '%?' AND length(line) > 10 AND length(line || nxt) < 250")
def multiline_questions(spark, root):
    return questions.joined_lines(forms(spark, root), "form")


QLINES = f"SELECT doc_id, pos, line FROM ({LINES}) WHERE line <> ''"


def question_lines(spark, root):
    return forms(spark, root).select("doc_id", F.posexplode(F.split("form", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.strip(F.col("line")).alias("line")).where("line <> ''")


def clean_q_sql(c: str) -> str:
    q = STRIP(rf"regexp_replace({c}, '^[ \t]*([0-9]{{1,3}}[.)\-]|[a-eA-E][.)])[ \t]*', '')")
    q = STRIP(rf"regexp_replace({q}, '(?i)^(question[ \t]*[0-9]*\.?|q\.?[ \t]*[0-9]*\.?)[ \t]*[:\-]?[ \t]*', '')")
    q = STRIP(rf"regexp_replace({q}, '\*{{1,2}}([^*]+)\*{{1,2}}', '\1', 'g')")
    q = STRIP(rf"regexp_replace({q}, '(?i)[ \t]+\(see [A-Za-z0-9_ ]*\)$', '')")
    return STRIP(rf"regexp_replace({q}, '(?i)[ \t]*[\[(]?[ \t]*required[ \t]*[\])]?[ \t]*$', '')")


SQL["question_regex"] = questions_sql()


@query(f"SELECT doc_id, pos, upper(left(q, 1)) || substring(q, 2) AS question FROM (SELECT doc_id, pos, {clean_q_sql('line')} AS q FROM ({QLINES})) WHERE length(q) >= 4")
def question_clean(spark, root):
    return question_lines(spark, root).select("doc_id", "pos", T.clean_question(F.col("line")).alias("question")).where(F.length("question") >= 4)


@query(f"SELECT doc_id, pos, regexp_replace(regexp_replace({STRIP('lower(line)')}, '[?. ]+$', ''), '{SP}+', ' ', 'g') AS norm FROM ({QLINES})")
def question_norm(spark, root):
    return question_lines(spark, root).select("doc_id", "pos", T.normal_question(F.col("line")).alias("norm"))


@query(rf"SELECT doc_id, pos, line FROM ({QLINES}) WHERE NOT regexp_matches(line, '(?i)^[ \t]*([a-e][.)][ \t]|[①②③④⑤]|\([ \t]*[a-e][ \t]*\)|(strongly agree|strongly disagree|agree|disagree|neutral|very (satisfied|dissatisfied)|not applicable|n/?a|always|usually|sometimes|rarely|never|yes|no|true|false|other)[ \t]*$)')")
def drop_answer_options(spark, root):
    return question_lines(spark, root).where(~questions.is_answer_option(F.col("line")))


@query(f"SELECT doc_id, count(*) AS hits FROM ({QLINES}) WHERE contains(lower(line), lower('PLEASE')) OR contains(lower(line), 'how') GROUP BY doc_id")
def question_search(spark, root):
    q = F.lower("line")
    return question_lines(spark, root).where(q.contains("please") | q.contains("how")).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("SELECT result_id, array_to_string(list_concat(questions, list_transform(questions, lambda q: upper(q))), '|') AS questions, CASE WHEN len(questions) > 0 THEN 'hybrid' ELSE 'none' END AS method FROM (SELECT result_id, max(coalesce(questions, [])) AS questions FROM pipeline_results GROUP BY result_id)")
def question_union(spark, root):
    rows = read(spark, root, "pipeline_results").groupBy("result_id").agg(F.max(F.coalesce("questions", F.array().cast("array<string>"))).alias("q"))
    return rows.select("result_id", F.array_join(F.concat("q", F.transform("q", lambda x: F.upper(x))), "|").alias("questions"), F.when(F.size("q") > 0, "hybrid").otherwise("none").alias("method"))


@query()
def question_dedup(spark, root):
    return questions.greedy_distinct(questions.extract(forms(spark, root), "form"))


# entities, citations, summaries

ENTITY_SQL = ", ".join(f"list_slice(list_filter(regexp_extract_all(form, '{p}'), lambda x, i: list_position(regexp_extract_all(form, '{p}'), x) = i), 1, {n}) AS {name}" for name, p, n in reports.ENTITIES)


@query(f"SELECT doc_id, {ENTITY_SQL} FROM ({FORMS})")
def entities_regex(spark, root):
    return reports.entities(forms(spark, root), "form")


CITED = "coalesce(summary, '') || ' [Source: Pages ' || (result_id % 9 + 1) || ', ' || (result_id % 5 + 1) || ']'"


@query(rf"SELECT result_id, i - 1 AS paragraph_index, pages, left(p, 60) AS section FROM (SELECT result_id, i, ps[i] AS p, list_transform(flatten(list_transform(regexp_extract_all(ps[i], '\[Source: Pages? ([^\]]+)\]', 1), lambda x: string_split(x, ','))), lambda x: trim(x)) AS pages FROM (SELECT DISTINCT result_id, string_split({CITED}, chr(10) || chr(10)) AS ps FROM pipeline_results WHERE summary <> ''), range(1, len(ps) + 1) r(i)) WHERE len(pages) > 0")
def parse_citations(spark, root):
    rows = read(spark, root, "pipeline_results").where("summary <> ''").select("result_id", F.concat(F.coalesce("summary", F.lit("")), F.lit(" [Source: Pages "), (F.col("result_id") % 9 + 1).cast("string"), F.lit(", "), (F.col("result_id") % 5 + 1).cast("string"), F.lit("]")).alias("summary")).distinct()
    return reports.citations(rows)


@query(r"SELECT result_id, pos, kind, count(*) OVER (PARTITION BY result_id) AS lines FROM (SELECT result_id, i - 1 AS pos, CASE WHEN regexp_matches(l[i], '^# ') THEN 'h1' WHEN regexp_matches(l[i], '^## ') THEN 'h2' WHEN regexp_matches(l[i], '^#{3,} ') THEN 'h3' WHEN regexp_matches(l[i], '^[-*•] ') THEN 'bullet' WHEN regexp_matches(l[i], '^[0-9]+[.)] ') THEN 'numbered' ELSE 'paragraph' END AS kind, trim(l[i]) AS line FROM (SELECT DISTINCT result_id, string_split(summary, chr(10)) AS l FROM pipeline_results WHERE summary IS NOT NULL), range(1, len(l) + 1) r(i)) WHERE line <> ''")
def summary_lines(spark, root):
    return reports.summary_lines(read(spark, root, "pipeline_results").where("summary IS NOT NULL").select("result_id", "summary").distinct())


@query(rf"SELECT result_id, i - 1 AS pos, CASE WHEN regexp_matches(s, '^#{{1,2}}[ \t]') THEN 'heading' WHEN regexp_matches(s, '^#{{3,6}}[ \t]') THEN 'subheading' WHEN regexp_matches(s, '^[•*-][ \t]') THEN 'bullet' WHEN regexp_matches(s, '^[0-9]+\.[ \t]') THEN 'numbered' ELSE 'body' END AS kind, {STRIP(r"regexp_replace(regexp_replace(s, '^(#{1,6}[ \t]+|[•*-][ \t]+|[0-9]+\.[ \t]+)', ''), '[~>]', '', 'g')")} AS spoken FROM (SELECT result_id, i, {STRIP('l[i]')} AS s FROM (SELECT DISTINCT result_id, string_split(regexp_replace(regexp_replace(summary, '\[Source:[^\]]*\]', '', 'g'), '\[[0-9]+\]', '', 'g'), chr(10)) AS l FROM pipeline_results WHERE summary IS NOT NULL), range(1, len(l) + 1) r(i)) WHERE s <> ''")
def tts_segments(spark, root):
    return reports.speech_segments(read(spark, root, "pipeline_results").where("summary IS NOT NULL").select("result_id", "summary").distinct())


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(form, '\*\*([^*]+)\*\*', '<b>\1</b>', 'g'), '(^|[^\p{L}\p{N}_])_([^_]+)_', '\1<i>\2</i>', 'g'), '(?m)^- ', '• ', 'g') AS markup FROM (" + FORMS + ")")
def md_inline(spark, root):
    t = F.regexp_replace(F.regexp_replace("form", r"\*\*([^*]+)\*\*", "<b>$1</b>"), r"(^|[^\p{L}\p{N}_])_([^_]+)_", "$1<i>$2</i>")
    return forms(spark, root).select("doc_id", F.regexp_replace(t, r"(?md)^- ", "• ").alias("markup"))


@query(r"SELECT DISTINCT result_id, CASE WHEN regexp_matches(summary, '^##? ') THEN regexp_extract(summary, '^##? ([^\n]*)', 1) ELSE file_name END AS title FROM pipeline_results WHERE summary IS NOT NULL")
def report_title(spark, root):
    return read(spark, root, "pipeline_results").where("summary IS NOT NULL").select("result_id", F.when(F.col("summary").rlike("^##? "), F.regexp_extract("summary", r"^##? ([^\n]*)", 1)).otherwise(F.col("file_name")).alias("title")).distinct()


FOLD_FROM, FOLD_TO = T.FIXED_SPACES + "\u2010\u2011\u2012\u2013\u2014\u2018\u2019\u201c\u201d", "    -----''''\"\""


def fold_sql(c: str) -> str:
    t = f"translate(lower({c}), '{FOLD_FROM}', '{FOLD_TO}')"
    for p, r in ((r"([0-9]),([0-9])", r"\1\2"), (r"([a-z])-([a-z])", r"\1 \2")):
        t = f"regexp_replace(regexp_replace({t}, '{p}', '{r}', 'g'), '{p}', '{r}', 'g')"
    return f"regexp_replace({t}, '{SP}+', ' ', 'g')"


@query(f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents WHERE text IS NOT NULL")
def match_fold(spark, root):
    return read(spark, root, "documents").where("text IS NOT NULL").select("doc_id", T.fold_for_match(F.col("text")).alias("folded"))


@query("SELECT doc_id, regexp_matches(' ' || lower(form) || ' ', '[^0-9]' || (doc_id % 7) || '[^0-9]') AS has_number FROM (SELECT doc_id, replace(replace(form, '.', ' '), ',', ' ') AS form FROM (" + FORMS + "))")
def whole_value(spark, root):
    return forms(spark, root).select("doc_id", T.contains_value(F.translate("form", ".,", "  "), (F.col("doc_id") % 7).cast("string")).alias("has_number"))


REFUSALS = ("The figure is not stated.", "We are unable to find it.", "The text only lists prices.", "See page 4, p. 7 and Pages 12.", "No total was given on p.3")
SAID = "coalesce(summary, '') || ' ' || [" + ", ".join(f"'{x}'" for x in REFUSALS) + "][result_id % 5 + 1]"


def said(spark, root):
    """Every summary followed by one of REFUSALS in turn."""
    return read(spark, root, "pipeline_results").select("result_id", F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.element_at(F.array(*map(F.lit, REFUSALS)), (F.col("result_id") % 5 + 1).cast("int"))).alias("reply")).distinct()


@query(f"SELECT DISTINCT result_id, {SAID} AS reply, regexp_matches({SAID}, '{T.DECLINE.replace(chr(39), chr(39) * 2)}') AS declined FROM pipeline_results")
def decline(spark, root):
    return said(spark, root).select("result_id", "reply", T.declines(F.col("reply")).alias("declined"))


CLAIMED = f"list_sort(list_distinct(list_transform(regexp_extract_all(reply, '{T.CLAIM}', 0), lambda x: regexp_extract(x, '[0-9]+')::BIGINT)))"


@query(f"SELECT result_id, pages, CASE WHEN result_id % 7 = 0 THEN 'n/a' WHEN len(pages) = 0 THEN 'none' WHEN list_contains(pages, result_id % 9 + 1) THEN 'correct' ELSE 'wrong' END AS verdict FROM (SELECT result_id, {CLAIMED} AS pages FROM (SELECT DISTINCT result_id, {SAID} AS reply FROM pipeline_results))")
def citation_verdict(spark, root):
    from leafstack.operators import evaluate

    expected = F.when(F.col("result_id") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("result_id") % 9 + 1))
    return said(spark, root).select("result_id", T.claimed_pages(F.col("reply")).alias("pages"), evaluate.citation_verdict(F.col("reply"), expected).alias("verdict"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN a AND b WHEN doc_id % 3 = 1 THEN a OR b ELSE false END AS hit FROM (SELECT doc_id, regexp_matches(t, '[^0-9]' || (doc_id % 7) || '[^0-9]') AS a, regexp_matches(t, '[^0-9]' || (doc_id % 13 + 20) || '[^0-9]') AS b FROM (SELECT doc_id, ' ' || lower(replace(replace(form, '.', ' '), ',', ' ')) || ' ' AS t FROM (" + FORMS + ")))")
def answer_hit(spark, root):
    from leafstack.operators import evaluate

    d = F.col("doc_id")
    both = F.array((d % 7).cast("string"), (d % 13 + 20).cast("string"))
    none = F.array().cast("array<string>")
    return forms(spark, root).select("doc_id", evaluate.answer_hit(F.translate("form", ".,", "  "), F.when(d % 3 == 0, both).otherwise(none), F.when(d % 3 == 1, both).otherwise(none)).alias("hit"))


@query(f"SELECT doc_id, CASE WHEN min(chunk_index) = max(chunk_index) THEN [coalesce(min_by(page_no, chunk_index), 0)] ELSE [arg_min(coalesce(page_no, 0), chunk_index), arg_max(coalesce(page_no, 0), chunk_index)] END AS anchors FROM ({CHUNKS}) GROUP BY doc_id")
def anchor_sources(spark, root):
    from leafstack.operators import evaluate

    return evaluate.anchor_sources(chunk_rows(spark, root).select("doc_id", F.col("chunk_index").alias("pos"), F.coalesce("page_no", F.lit(0)).alias("source")))


# tables and sheets

@query("SELECT l_orderkey, string_agg(l_linenumber || ' | ' || l_quantity::BIGINT || ' | ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_linenumber || ' | ' || l_quantity::BIGINT || ' | ' || l_returnflag) AS rendered FROM lineitem GROUP BY l_orderkey")
def table_render(spark, root):
    rows = read(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("bigint").cast("string"), F.col("l_returnflag")).alias("cells"))
    return tables.render(rows, "l_orderkey", "l_linenumber")


@query("SELECT doc_id, chunk_index, header, n_numeric::DOUBLE / greatest(n, 1) < 0.5 AS is_header FROM (SELECT doc_id, chunk_index, l AS header, len(list_filter(string_split(l, ' | '), lambda x: trim(x) <> '' AND regexp_full_match(replace(replace(replace(trim(x), '.', ''), ',', ''), '-', ''), '[0-9]+'))) AS n_numeric, len(list_filter(string_split(l, ' | '), lambda x: trim(x) <> '')) AS n FROM (SELECT doc_id, chunk_index, list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | '))[1] AS l FROM (" + CHUNKS + ") WHERE sheet_name IS NOT NULL AND text IS NOT NULL) WHERE l IS NOT NULL)")
def header_detect(spark, root):
    return tables.headers(chunk_rows(spark, root).where("sheet_name IS NOT NULL AND text IS NOT NULL"))


@query("SELECT l_returnflag, count(*) AS kept, sum(l_orderkey) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE r <= 300 OR r > n - 300 GROUP BY l_returnflag")
def head_tail_sample(spark, root):
    return tables.head_tail(read(spark, root, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"]).groupBy("l_returnflag").agg(F.count("*").alias("kept"), F.sum("l_orderkey").alias("keys"))


@query("SELECT count(*) AS n, count(o_totalprice) AS filled, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most, count(DISTINCT o_orderpriority) AS kinds FROM orders")
def csv_profile(spark, root):
    return tables.csv_round_trip(read(spark, root, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"))


@query("SELECT id, file_name, word_count FROM history WHERE NOT (content_text IS NULL AND content_chunks_json IS NULL AND content_embeddings_b64 IS NULL)")
def drop_empty_rows(spark, root):
    return read(spark, root, "history").dropna("all", subset=["content_text", "content_chunks_json", "content_embeddings_b64"]).select("id", "file_name", "word_count")
