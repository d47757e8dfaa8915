"""The document store: upsert by content, corpus build, usage accounts, request limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafstack.functions import text as T

#: How uploads are routed.
ROUTES = {".pdf": "pdf", ".xlsx": "excel", ".xls": "excel", ".csv": "excel", ".mp3": "audio", ".m4a": "audio", ".wav": "audio", ".flac": "audio", ".ogg": "audio", ".webm": "audio"}
MOST_BYTES = 50 * 1024 * 1024


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def route(name: Column) -> Column:
    """``pdf``, ``excel`` or ``audio`` by extension; null for any other."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ROUTES.items() for x in kv)), extension(name))


def validate(name: Column, size: Column) -> Column:
    """The first fault of an upload, or null."""
    return F.when(F.coalesce(name, F.lit("")) == "", "no file").when(route(name).isNull(), F.concat(F.lit("unsupported type "), extension(name))).when(size > MOST_BYTES, "too large")


def content_hash(content: Column, name: Column, words: Column) -> Column:
    """SHA-256 of the content, or without content of name and word count."""
    return F.sha2(F.coalesce(F.nullif(content, F.lit("")), F.concat(name, F.lit(":"), words.cast("string"))), 256)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key. The rank is cut to one row a group before the shuffle, so a hot key costs no more than others."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(store: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Store and batch merged: the newest row per key, columns that either lacks filled with nulls."""
    return latest(store.unionByName(batch, allowMissingColumns=True), [key], order)


def save(rows: DataFrame, path: str, key: str = "file_hash", buckets: int = 64) -> None:
    """Writes the newest row per key into hash buckets; only the buckets that ``rows`` touch are rewritten."""
    spark = rows.sparkSession
    parted = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in parted.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    try:
        old = spark.read.option("mergeSchema", "true").parquet(path).where(F.col("bucket").isin(touched))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = parted.limit(0)
    from leafstack.session import materialize

    merged = materialize(upsert(old, parted, key, [F.desc("created_at"), F.desc("id")]), "upsert")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def delete(spark, path: str, condition: str) -> None:
    """Rewrites the store without the rows that meet ``condition``."""
    from leafstack.session import materialize

    kept = materialize(spark.read.parquet(path).where(f"NOT coalesce({condition}, false)"), "delete")
    kept.write.mode("overwrite").partitionBy("bucket").parquet(path)


def display_names(rows: DataFrame) -> DataFrame:
    """Names made distinct: the newest of a name keeps it, earlier ones get their id. A hot name is ranked by its first row only."""
    newest = rows.groupBy("file_name").agg(F.max(F.struct("created_at", "id")).alias("top"))
    joined = rows.join(newest.select(F.col("file_name").alias("n"), F.col("top.id").alias("first")), F.col("file_name").eqNullSafe(F.col("n"))).drop("n")
    return joined.withColumn("display", F.when(F.col("id") == F.col("first"), F.col("file_name")).otherwise(F.concat("file_name", F.lit(" (#"), F.col("id").cast("string"), F.lit(")")))).drop("first")


def cost(prompt: Column, completion: Column, price_in: float = 0.15, price_out: float = 0.60) -> Column:
    """Price of a call at prices for a million tokens."""
    return prompt / 1e6 * price_in + completion / 1e6 * price_out


def token_budget(content: Column) -> Column:
    """Tokens to ask for: room for reasoning on top, within 8000 unless more is wanted."""
    return F.least(content + 1024, F.greatest(content, F.lit(8000)))


def park_seconds(wait: Column, limit: Column, used: Column, requested: Column, least: int = 500) -> Column:
    """How long to leave a key alone: the wait, scaled to the smallest request worth making."""
    head = limit - used
    deficit, target = requested - head, F.lit(least) - head
    return F.when(wait.isNull() | limit.isNull() | used.isNull() | requested.isNull() | (deficit <= 0), wait).when(target <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(wait, wait * target / deficit)))


def rate_limit(message: Column) -> list[Column]:
    """Facts of a refusal: kind of limit, window, figures, seconds to wait."""
    numbers = lambda g: F.nullif(F.regexp_extract(message, r"Limit ([0-9]+), Used ([0-9]+), Requested ([0-9]+)", g), F.lit("")).cast("bigint")
    wait = F.regexp_replace(F.regexp_extract(message, r"try again in ([0-9hms.]+)", 1), r"\.+$", "")
    return [F.nullif(F.regexp_extract(message, r"on (tokens|requests) per (day|minute) \((RPD|TPD|RPM|TPM)\)", 3), F.lit("")).alias("limit_type"), numbers(1).alias("limit_n"), numbers(2).alias("used_n"), numbers(3).alias("requested_n"), T.duration_seconds(F.nullif(wait, F.lit(""))).alias("wait_seconds")]


#: The keys of an exported result, in order.
EXPORTED = ("file_name", "file_type", "doc_type", "domain", "classification_confidence", "classification_method", "summary", "summary_method", "questions", "entities", "extraction_method", "metadata", "word_count", "page_count", "processing_time_ms", "skill_timings", "warnings", "errors", "success", "created_at")


def result_json(results: DataFrame) -> DataFrame:
    """``result_id, result_json``: one object a result with the keys of EXPORTED, from its newest row; keys without a column are empty, nulls stay as keys."""
    held = {c: F.col(c) for c in results.columns}
    empty = {"questions": F.array().cast("array<string>"), "warnings": F.array().cast("array<string>"), "errors": F.array().cast("array<string>"), "summary": F.lit(""), "entities": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), "metadata": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), "skill_timings": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))}
    value = lambda k: F.coalesce(held[k], empty[k]) if k in held and k in empty else held[k] if k in held else empty.get(k, F.lit(None).cast("string"))
    rows = results.select("result_id", *(value(k).alias(k) for k in EXPORTED), *(c for c in ("stored_at",) if c in held))
    first = ["created_at", *(c for c in ("stored_at",) if c in held), "summary", "file_name", "doc_type", "file_type"]
    ordered = F.max_by(F.to_json(F.struct(*EXPORTED), {"ignoreNullFields": "false"}), F.struct(*first)).alias("result_json")
    return rows.groupBy("result_id").agg(ordered)
