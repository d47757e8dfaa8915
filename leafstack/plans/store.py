"""Queries of sources, sinks, the store and accounts."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from leafstack.functions import text as T
from leafstack import providers
from leafstack.operators import store as S
from leafstack.operators import vectors
from leafstack.plans.base import query
from leafstack.plans.documents import CHUNKS, STRIP, chunk_rows
from leafstack.session import read_table as read

ROUTE = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in S.ROUTES.items()) + "}[lower(regexp_extract(file_name, '(\\.[^./]+)$', 1))]"
#: File names of the results, with some that no reader takes.
NAMES = "SELECT DISTINCT result_id, CASE WHEN result_id % 7 = 0 THEN file_name || '.docx' ELSE file_name END AS file_name, (result_id % 90) * 1000000 AS bytes FROM pipeline_results"


def names(spark, root):
    n = F.when(F.col("result_id") % 7 == 0, F.concat("file_name", F.lit(".docx"))).otherwise(F.col("file_name"))
    return read(spark, root, "pipeline_results").select("result_id", n.alias("file_name"), (F.col("result_id") % 90 * 1000000).alias("bytes")).distinct()


@query(f"SELECT result_id, {ROUTE} AS route FROM ({NAMES})")
def route_by_extension(spark, root):
    return names(spark, root).select("result_id", S.route(F.col("file_name")).alias("route"))


@query(f"SELECT result_id, CASE WHEN coalesce(file_name, '') = '' THEN 'no file' WHEN {ROUTE} IS NULL THEN 'unsupported type ' || lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) WHEN bytes > 52428800 THEN 'too large' END AS fault FROM ({NAMES})")
def validate_inputs(spark, root):
    return names(spark, root).select("result_id", S.validate(F.col("file_name"), F.col("bytes")).alias("fault"))


@query(r"SELECT event_id, regexp_extract(url, '(?:youtube\.com/watch\?v=|youtu\.be/)([a-zA-Z0-9_-]{11})', 1) AS video, regexp_matches(url, '^https?://(www\.)?(youtube\.com|youtu\.be)/') AS valid FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'https://www.youtube.com/watch?v=' || lpad(event_id::VARCHAR, 11, 'a') WHEN event_id % 3 = 1 THEN 'https://youtu.be/' || lpad(event_id::VARCHAR, 11, 'B') ELSE 'https://example.org/' || event_id END AS url FROM events)")
def url_parse(spark, root):
    e = F.col("event_id")
    url = F.when(e % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(e.cast("string"), 11, "a"))).when(e % 3 == 1, F.concat(F.lit("https://youtu.be/"), F.lpad(e.cast("string"), 11, "B"))).otherwise(F.concat(F.lit("https://example.org/"), e.cast("string")))
    return read(spark, root, "events").select("event_id", F.regexp_extract(url, r"(?:youtube\.com/watch\?v=|youtu\.be/)([a-zA-Z0-9_-]{11})", 1).alias("video"), url.rlike(r"^https?://(www\.)?(youtube\.com|youtu\.be)/").alias("valid"))


@query("SELECT doc_id, coalesce(nullif(full_text, ''), nullif('ocr ' || file_name, ''), 'none') AS content, CASE WHEN full_text <> '' THEN 'primary' ELSE 'ocr' END AS engine FROM parsed_documents")
def reader_cascade(spark, root):
    t = F.nullif("full_text", F.lit(""))
    return read(spark, root, "parsed_documents").select("doc_id", F.coalesce(t, F.concat(F.lit("ocr "), "file_name"), F.lit("none")).alias("content"), F.when(t.isNotNull(), "primary").otherwise("ocr").alias("engine"))


@query("SELECT id, file_name, CASE WHEN length(content_text) > 200 THEN left(content_text, 200) || '…' ELSE content_text END AS snippet FROM history ORDER BY created_at DESC, id DESC LIMIT 20")
def recent_documents(spark, root):
    snippet = F.when(F.length("content_text") > 200, F.concat(F.left("content_text", F.lit(200)), F.lit("…"))).otherwise(F.col("content_text"))
    return read(spark, root, "history").orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", "file_name", snippet.alias("snippet"))


@query("SELECT hash, id, file_name FROM (SELECT lower(file_hash) AS hash, id, file_name, row_number() OVER (PARTITION BY lower(file_hash) ORDER BY id DESC) AS r FROM history WHERE file_hash IS NOT NULL) WHERE r = 1")
def find_by_hash(spark, root):
    rows = read(spark, root, "history").where("file_hash IS NOT NULL").select(F.lower("file_hash").alias("hash"), "id", "file_name")
    return rows.groupBy("hash").agg(F.max(F.struct("id", "file_name")).alias("r")).select("hash", "r.*")


MERGED = "SELECT id, lower(file_hash) AS hash, file_name, word_count FROM history WHERE file_hash IS NOT NULL UNION ALL SELECT id, lower(file_hash), file_name, word_count FROM incoming WHERE file_hash IS NOT NULL"


@query(f"SELECT hash, id, file_name, word_count FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id DESC, file_name DESC, word_count DESC) AS r FROM ({MERGED})) WHERE r = 1")
def upsert_latest(spark, root):
    part = lambda t: read(spark, root, t).where("file_hash IS NOT NULL").select("id", F.lower("file_hash").alias("hash"), "file_name", "word_count")
    return S.upsert(part("history"), part("incoming"), "hash", [F.desc("id"), F.desc("file_name"), F.desc("word_count")])


@query("SELECT id, file_name, batch_no, chunk_scheme FROM (SELECT id, file_name, NULL::INTEGER AS batch_no, chunk_scheme FROM history UNION ALL SELECT id, file_name, batch_no, NULL FROM incoming)")
def schema_evolve(spark, root):
    return read(spark, root, "history").select("id", "file_name", "chunk_scheme").unionByName(read(spark, root, "incoming").select("id", "file_name", "batch_no"), allowMissingColumns=True)


NEWEST = "SELECT id, file_name, created_at, content_text, row_number() OVER (PARTITION BY file_name ORDER BY created_at DESC, id DESC) AS r FROM history"


@query(f"SELECT id, CASE WHEN r = 1 THEN file_name ELSE file_name || ' (#' || id || ')' END AS display FROM ({NEWEST})")
def dup_names(spark, root):
    return S.display_names(read(spark, root, "history").select("id", "file_name", "created_at")).select("id", "display")


@query("WITH newest AS (SELECT id, file_name, created_at, content_text FROM history ORDER BY created_at DESC, id DESC LIMIT 25) SELECT id, CASE WHEN row_number() OVER (PARTITION BY file_name ORDER BY created_at DESC, id DESC) = 1 THEN file_name ELSE file_name || ' (#' || id || ')' END AS display, coalesce(content_text, '') = '' AS skipped, (SELECT count(*) FROM history) > 25 AS truncated FROM newest")
def corpus_build(spark, root):
    rows = read(spark, root, "history").select("id", "file_name", "created_at", "content_text")
    newest = S.display_names(rows.orderBy(F.desc("created_at"), F.desc("id")).limit(25))
    total = rows.agg((F.count("*") > 25).alias("truncated"))
    return newest.select("id", "display", (F.coalesce("content_text", F.lit("")) == "").alias("skipped")).withColumn("k", F.lit(1)).join(F.broadcast(total.withColumn("k", F.lit(1))), "k").drop("k")


PARTS = "SELECT id, embedding_model, coalesce(chunk_scheme, 'page') AS scheme, json_array_length(content_chunks_json) AS elements, length(content_embeddings_b64) / 4 * 3 - CASE WHEN content_embeddings_b64 LIKE '%==' THEN 2 WHEN content_embeddings_b64 LIKE '%=' THEN 1 ELSE 0 END AS bytes, CASE embedding_model WHEN 'mini-passage-64' THEN 64 WHEN 'edge-passage-48' THEN 48 END AS dims, content_chunks_json FROM history WHERE json_valid(content_chunks_json) AND (content_embeddings_b64 IS NULL OR regexp_full_match(content_embeddings_b64, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?'))"


@query(f"SELECT id, elements AS chunks, CASE WHEN bytes = elements * dims * 4 THEN elements ELSE 0 END AS vectors, coalesce(bytes = elements * dims * 4 AND elements > 0, false) AS searchable FROM ({PARTS})")
def corpus_status(spark, root):
    return vectors.status(read(spark, root, "history"))


@query(f"SELECT id, elements, coalesce(bytes = elements * dims * 4 AND elements > 0 AND embedding_model = 'mini-passage-64' AND scheme = 'passage:100/20', false) AS attached FROM ({PARTS})")
def attach_vectors(spark, root):
    return vectors.attachable(read(spark, root, "history"), "mini-passage-64", "passage:100/20")


@query(f"SELECT id, elements, bytes = elements * dims * 4 AS complete FROM ({PARTS}) WHERE id % 50 = 0")
def load_with_vectors(spark, root):
    rows = vectors.parts(read(spark, root, "history").where("id % 50 = 0"))
    return rows.select("id", "elements", (F.col("bytes") == F.col("elements") * F.col("dims") * 4).alias("complete"))


@query(f"SELECT id, i AS passage_index, json_extract_string(content_chunks_json, '$[' || i || '].text') AS text, CASE WHEN bytes = elements * dims * 4 AND embedding_model = 'mini-passage-64' AND scheme = 'passage:100/20' THEN 64 END AS dims FROM ({PARTS} AND json_type(content_chunks_json) = 'ARRAY'), range(0, elements::BIGINT) r(i)")
def passages_with_vectors(spark, root):
    """Every stored passage with its vector, where it may be used."""
    rows = vectors.passage_vectors(read(spark, root, "history").where(F.col("content_embeddings_b64").isNull() | F.col("content_embeddings_b64").rlike(vectors.BASE64)), "mini-passage-64", "passage:100/20")
    return rows.select("id", F.col("passage_index").cast("bigint").alias("passage_index"), "text", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dims"))


@query(f"SELECT id, i AS passage_index, text, attached AS kept, 64 AS dims FROM (SELECT id, i, json_extract_string(content_chunks_json, '$[' || i || '].text') AS text, coalesce(bytes = elements * dims * 4 AND embedding_model = 'mini-passage-64' AND scheme = 'passage:100/20', false) AS attached FROM ({PARTS} AND json_type(content_chunks_json) = 'ARRAY'), range(0, elements::BIGINT) r(i)) WHERE attached OR text <> ''")
def vectors_filled(spark, root):
    """The same with the missing vectors made by the (offline) model; a passage without text has none."""
    rows = vectors.passage_vectors(read(spark, root, "history").where(F.col("content_embeddings_b64").isNull() | F.col("content_embeddings_b64").rlike(vectors.BASE64)), "mini-passage-64", "passage:100/20")
    made = providers.fill_gaps(rows, "text", "vector", providers.Offline(64), "id").where("vector IS NOT NULL")
    return made.select("id", F.col("passage_index").cast("bigint").alias("passage_index"), "text", (~F.col("filled")).alias("kept"), F.size("vector").alias("dims"))


@query("SELECT vec_id, (len(embedding) * 4 + 2) // 3 * 4 AS chars, true AS same FROM embeddings WHERE embedding IS NOT NULL")
def vector_codec(spark, root):
    return vectors.round_trip(read(spark, root, "embeddings")).select("vec_id", F.length("blob").cast("bigint").alias("chars"), "same")


@query("SELECT count(*) AS documents, count(DISTINCT file_name) AS names, count(DISTINCT lower(file_hash)) AS hashes FROM history")
def corpus_counts(spark, root):
    return read(spark, root, "history").agg(F.count("*").alias("documents"), F.countDistinct("file_name").alias("names"), F.countDistinct(F.lower("file_hash")).alias("hashes"))


@query("SELECT id, sha256(coalesce(nullif(content_text, ''), file_name || ':' || word_count)) AS hash FROM history")
def content_hash(spark, root):
    return read(spark, root, "history").select("id", S.content_hash(F.col("content_text"), F.col("file_name"), F.col("word_count")).alias("hash"))


# accounts

@query("SELECT event_type AS model, count(*) AS calls, count_if(user_id % 2 = 0) AS cache_hits, round(sum(value), 4) AS prompt_tokens FROM events GROUP BY event_type")
def usage_rollup(spark, root):
    return read(spark, root, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.count_if(F.col("user_id") % 2 == 0).alias("cache_hits"), F.round(F.sum("value"), 4).alias("prompt_tokens"))


@query("SELECT event_type AS model, round(sum(value / 1e6 * 0.15 + user_id / 1e6 * 0.60), 8) AS cost FROM events GROUP BY event_type")
def usage_cost(spark, root):
    return read(spark, root, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.sum(S.cost(F.col("value"), F.col("user_id"))), 8).alias("cost"))


@query("SELECT event_type AS stage, round(sum(value), 4) AS ms, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type")
def timing_share(spark, root):
    per = read(spark, root, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("s"))
    return per.select("stage", F.round("s", 4).alias("ms"), F.round(F.col("s") / F.sum("s").over(W.partitionBy()), 6).alias("share"))


@query("SELECT DISTINCT result_id, least(w + 1024, greatest(w, 8000)) AS budget FROM (SELECT result_id, coalesce(word_count, 0) * 10 AS w FROM pipeline_results)")
def token_budget(spark, root):
    return read(spark, root, "pipeline_results").select("result_id", S.token_budget(F.coalesce("word_count", F.lit(0)) * 10).alias("budget")).distinct()


@query("SELECT event_id, floor(100 * CASE WHEN deficit <= 0 THEN wait WHEN target <= 0 THEN 0.0 ELSE greatest(0.0, least(wait, wait * target / deficit)) END) AS park FROM (SELECT event_id, value AS wait, 2000 - (100000 - 99000 - user_id * 20) AS deficit, 500 - (100000 - 99000 - user_id * 20) AS target FROM events)")
def park_seconds(spark, root):
    used = F.lit(99000) + F.col("user_id") * 20
    return read(spark, root, "events").select("event_id", F.floor(100 * S.park_seconds(F.col("value"), F.lit(100000), used, F.lit(2000))).alias("park"))


@query("SELECT event_id, round(CASE WHEN m = 0 THEN (event_id % 5) * 3600 + (event_id % 60) * 60 + 19.2 WHEN m = 1 THEN (event_id % 900) / 1000.0 WHEN m = 2 THEN event_id % 100 END, 6) AS seconds FROM (SELECT event_id, event_id % 4 AS m FROM events)")
def duration_parse(spark, root):
    e = F.col("event_id")
    s = lambda m: (e % m).cast("string")
    text = F.when(e % 4 == 0, F.concat(s(5), F.lit("h"), s(60), F.lit("m19.2s"))).when(e % 4 == 1, F.concat(s(900), F.lit("ms"))).when(e % 4 == 2, s(100)).otherwise("junk")
    return read(spark, root, "events").select("event_id", F.round(T.duration_seconds(text), 6).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'TPD' END AS limit_type, CASE WHEN event_id % 2 = 0 THEN 100000 END AS limit_n, CASE WHEN event_id % 2 = 0 THEN event_id END AS used_n, CASE WHEN event_id % 2 = 0 THEN user_id END AS requested_n, CASE WHEN event_id % 2 = 0 THEN round((event_id % 59) * 60 + 3.936, 6) END AS wait_seconds FROM events")
def ratelimit_parse(spark, root):
    e = F.col("event_id")
    message = F.when(e % 2 == 0, F.concat(F.lit("Rate limit reached in organization `o` on tokens per day (TPD): Limit 100000, Used "), e.cast("string"), F.lit(", Requested "), F.col("user_id").cast("string"), F.lit(". Please try again in "), (e % 59).cast("string"), F.lit("m3.936s."))).otherwise("server error")
    return read(spark, root, "events").select("event_id", message.alias("m"), "user_id").select("event_id", *S.rate_limit(F.col("m"))).withColumn("limit_n", F.col("limit_n").cast("int")).withColumn("wait_seconds", F.round("wait_seconds", 6))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 'kept' END AS flag FROM events")
def json_field_filter(spark, root):
    k = F.from_json("props", "k int")["k"]
    return read(spark, root, "events").select("event_id", k.alias("k"), F.when(k > 50, "kept").alias("flag"))


@query("SELECT event_id, json_extract_string(regexp_extract('Sure: ' || props || ' done', '\\{[^}]*\\}'), '$.k') AS k FROM events")
def json_from_reply(spark, root):
    body = F.regexp_extract(F.concat(F.lit("Sure: "), "props", F.lit(" done")), r"\{[^}]*\}", 0)
    return read(spark, root, "events").select("event_id", F.get_json_object(body, "$.k").alias("k"))


ONE_RESULT = "SELECT result_id, file_name, file_type, doc_type, coalesce(summary, '') AS summary, coalesce(questions, []) AS questions FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY created_at DESC NULLS LAST, stored_at DESC NULLS LAST, coalesce(summary, '') DESC, file_name DESC NULLS LAST, doc_type DESC NULLS LAST, file_type DESC NULLS LAST) AS nth FROM pipeline_results) WHERE nth = 1"


def one_result(spark, root):
    """One whole row of each result: the newest, where the repeated ones differ."""
    text = F.coalesce("summary", F.lit("")).alias("summary")
    newest = F.max(F.struct("created_at", "stored_at", text, "file_name", "doc_type", "file_type", F.coalesce("questions", F.array().cast("array<string>")).alias("questions"))).alias("r")
    return read(spark, root, "pipeline_results").groupBy("result_id").agg(newest).select("result_id", "r.file_name", "r.file_type", "r.doc_type", "r.summary", "r.questions")


@query(f"SELECT result_id, '# Analysis Report' || chr(10) || chr(10) || '> **File:** `' || file_name || '`' || chr(10) || '> **Format:** ' || upper(file_type) || '  |  **Type:** ' || replace(doc_type, '_', ' ') || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || CASE WHEN summary = '' THEN '_No summary could be generated._' ELSE summary END || CASE WHEN len(questions) > 0 THEN chr(10) || chr(10) || '## Questions' || chr(10) || chr(10) || array_to_string(list_transform(questions, lambda q, i: i || '. ' || q), chr(10)) ELSE '' END AS report FROM ({ONE_RESULT})")
def result_markdown(spark, root):
    listed = F.array_join(F.transform("questions", lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")
    report = F.concat(F.lit("# Analysis Report\n\n> **File:** `"), "file_name", F.lit("`\n> **Format:** "), F.upper("file_type"), F.lit("  |  **Type:** "), F.replace("doc_type", F.lit("_"), F.lit(" ")), F.lit("\n\n## Summary\n\n"), F.when(F.col("summary") == "", "_No summary could be generated._").otherwise(F.col("summary")), F.when(F.size("questions") > 0, F.concat(F.lit("\n\n## Questions\n\n"), listed)).otherwise(""))
    return one_result(spark, root).select("result_id", report.alias("report"))


@query(f"SELECT result_id, i AS no, questions[i] AS question FROM ({ONE_RESULT}), range(1, len(questions) + 1) r(i)")
def questions_csv(spark, root):
    return one_result(spark, root).select("result_id", F.posexplode("questions").alias("p", "question")).select("result_id", (F.col("p") + 1).cast("bigint").alias("no"), "question")


@query()
def result_json(spark, root):
    """Every result as one JSON object of 20 keys."""
    return S.result_json(read(spark, root, "pipeline_results"))


@query(f"SELECT result_id, file_name, summary, len(questions) AS questions, 20 AS keys FROM ({ONE_RESULT})")
def result_export(spark, root):
    """Every result as one JSON object of 20 keys, read back."""
    made = result_json(spark, root)
    j = lambda k: F.get_json_object("result_json", f"$.{k}")
    return made.select("result_id", j("file_name").alias("file_name"), j("summary").alias("summary"), F.json_array_length(j("questions")).cast("bigint").alias("questions"), F.size(F.json_object_keys("result_json")).alias("keys"))


@query(f"SELECT q.result_id, i AS no, q.questions[i] AS question, 'answer ' || (q.result_id % 5) AS answer FROM ({ONE_RESULT}) q, range(1, len(questions) + 1) r(i) WHERE i % 2 = 1")
def form_answers(spark, root):
    q = questions_csv(spark, root)
    answers = q.where("no % 2 = 1").select("result_id", "no", F.concat(F.lit("answer "), (F.col("result_id") % 5).cast("string")).alias("answer"))
    return q.join(answers, ["result_id", "no"])


@query("SELECT doc_id, k AS key, left(v, 120) AS value FROM (SELECT doc_id, unnest(map_keys(metadata)) AS k, unnest(map_values(metadata)) AS v FROM parsed_documents) WHERE v <> '' AND k <> 'engine'")
def metadata_clean(spark, root):
    kept = F.map_filter("metadata", lambda k, v: (v != "") & (k != "engine"))
    return read(spark, root, "parsed_documents").select("doc_id", F.explode(F.slice(F.map_entries(kept), 1, 20)).alias("e")).select("doc_id", F.col("e.key").alias("key"), F.left("e.value", F.lit(120)).alias("value"))


@query("WITH c AS (SELECT l_returnflag AS sheet, l_orderkey * 10 + l_linenumber AS row, l_quantity::VARCHAR AS value FROM lineitem) SELECT CASE WHEN sheet = 'R' THEN 'returned' ELSE sheet END AS sheet, row, CASE WHEN sheet = 'A' THEN 'units' ELSE 'quantity' END AS \"column\", CASE WHEN sheet = 'N' AND row = 11 THEN '0' ELSE value END AS value FROM c WHERE NOT (sheet = 'N' AND row = 12) UNION ALL SELECT DISTINCT 'A', row, 'note', '-' FROM c WHERE sheet = 'A'")
def edit_ops(spark, root):
    from leafstack.operators import tables

    cells = read(spark, root, "lineitem").select(F.col("l_returnflag").alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.lit("quantity").alias("column"), F.col("l_quantity").cast("string").alias("value"))
    return tables.apply_edits(cells, [{"op": "rename_column", "sheet": "A", "old": "quantity", "new": "units"}, {"op": "set_cell_value", "sheet": "N", "row": 11, "column": "quantity", "value": "0"}, {"op": "rename_sheet", "sheet": "R", "new": "returned"}, {"op": "delete_row", "sheet": "N", "row": 12}, {"op": "add_column", "sheet": "A", "column": "note", "default": "-"}])


@query("SELECT event_id, CASE WHEN m = 0 THEN 'placeholder' WHEN m = 1 THEN 'short' WHEN m = 2 THEN 'white space' END AS fault FROM (SELECT event_id, event_id % 5 AS m FROM events)")
def key_plausibility(spark, root):
    e = F.col("event_id")
    key = F.when(e % 5 == 0, "gsk_replace_me_key_number_one").when(e % 5 == 1, "gsk_1234").when(e % 5 == 2, "gsk_abcdefghijkl mnopqrstuvwx").otherwise(F.concat(F.lit("gsk_"), F.sha2(e.cast("string"), 256)))
    return read(spark, root, "events").select("event_id", T.key_fault(key).alias("fault"))


@query("SELECT event_id, props AS bare FROM events")
def strip_fences(spark, root):
    e = F.col("event_id")
    reply = F.when(e % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(e % 3 == 1, F.concat(F.lit(" ```\n"), "props", F.lit("```  "))).otherwise(F.col("props"))
    return read(spark, root, "events").select("event_id", T.unfenced(reply).alias("bare"))


ESCAPED = "replace(replace(replace(replace(replace(q, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


@query(rf"SELECT result_id, no, regexp_replace({ESCAPED}, '(?i)(e\?|what)', '<mark>\1</mark>', 'g') AS shown FROM (SELECT result_id, i AS no, questions[i] || ' <what> & why' AS q FROM ({ONE_RESULT}), range(1, len(questions) + 1) r(i))")
def highlight_search(spark, root):
    shown = F.concat("question", F.lit(" <what> & why"))
    once = T.highlighted(shown, F.lit("what"))
    return questions_csv(spark, root).select("result_id", "no", F.regexp_replace(once, r"(?i)(e\?)", "<mark>$1</mark>").alias("shown"))
