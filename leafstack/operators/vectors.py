"""Stored vectors: which rows have usable ones, and the base64 form of float arrays."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Models are a column of few values; more are refused.
MOST_MODELS = 1_000
BASE64 = "^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def sizes(history: DataFrame) -> DataFrame:
    """``id, embedding_model, scheme, elements, bytes`` of the rows whose passages parse and whose vectors, if any, are base64."""
    blob = F.col("content_embeddings_b64")
    size = (F.length(blob) / 4 * 3 - F.when(blob.endswith("=="), 2).when(blob.endswith("="), 1).otherwise(0)).cast("double")
    rows = history.select("id", "embedding_model", F.coalesce("chunk_scheme", F.lit("page")).alias("scheme"), F.json_array_length("content_chunks_json").cast("bigint").alias("elements"), size.alias("bytes"), blob.alias("blob"))
    return rows.where("elements IS NOT NULL").where(F.col("blob").isNull() | F.col("blob").rlike(BASE64)).drop("blob")


def widths(history: DataFrame) -> DataFrame:
    """``embedding_model, dims``: floats per vector of each model, the width that most of its rows have (the larger of two)."""
    whole = sizes(history).where("elements > 0 AND bytes > 0 AND bytes % (4 * elements) = 0 AND embedding_model IS NOT NULL")
    seen = whole.groupBy("embedding_model", (F.col("bytes") / (4 * F.col("elements"))).cast("int").alias("dims")).agg(F.count("*").alias("n"))
    return seen.groupBy("embedding_model").agg(F.max_by("dims", F.struct("n", "dims")).alias("dims"))


def parts(history: DataFrame) -> DataFrame:
    """:func:`sizes` with the width of the row's model, ``dims``, null where no row of it tells."""
    return sizes(history).join(widths(history), "embedding_model", "left")


def passage_vectors(history: DataFrame, model: str, scheme: str) -> DataFrame:
    """``id, passage_index, text, vector``: every stored passage, with its stored vector where the row has one for each, of this model and scheme.

    Vectors meet passages by position. Rows with broken passages or vectors, of another model or scheme, or with another number of vectors come without.
    """
    usable = attachable(history, model, scheme).where("attached").select("id").distinct().withColumn("attached", F.lit(True))
    kind = "array<struct<text:string>>"
    rows = history.select("id", F.from_json("content_chunks_json", kind).alias("p"), "content_embeddings_b64").where("p IS NOT NULL").join(usable, "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "p": batch["p"], "v": [decode(b, len(base64.b64decode(b)) // (4 * len(p))).tolist() if ok is True and len(p) else None for p, b, ok in zip(batch["p"], batch["content_embeddings_b64"], batch["attached"])]})

    made = rows.mapInPandas(run, f"id bigint, p {kind}, v array<array<double>>")
    return made.select("id", "v", F.posexplode("p").alias("passage_index", "x")).select("id", "passage_index", "x.text", F.get("v", F.col("passage_index")).alias("vector"))


def _complete():
    return F.col("bytes") == F.col("elements") * F.col("dims") * 4


def status(history: DataFrame) -> DataFrame:
    """Passages, vectors and whether every passage has one."""
    return parts(history).select("id", F.col("elements").alias("chunks"), F.when(_complete(), F.col("elements")).otherwise(0).alias("vectors"), F.coalesce(_complete() & (F.col("elements") > 0), F.lit(False)).alias("searchable"))


def attachable(history: DataFrame, model: str, scheme: str) -> DataFrame:
    """Whether the stored vectors may be used under a model and scheme: others are ignored, not compared."""
    ok = _complete() & (F.col("elements") > 0) & (F.col("embedding_model") == model) & (F.col("scheme") == scheme)
    return parts(history).select("id", "elements", F.coalesce(ok, F.lit(False)).alias("attached"))


def encode(values: np.ndarray) -> str:
    return base64.b64encode(np.asarray(values, "<f4").tobytes()).decode()


def decode(blob: str, dims: int) -> np.ndarray | None:
    """Vectors of a string, or None where it is not base64 of whole vectors."""
    try:
        raw = base64.b64decode(blob, validate=True)
    except ValueError:
        return None
    return np.frombuffer(raw, "<f4").reshape(-1, dims) if dims and len(raw) % (4 * dims) == 0 else None


def round_trip(embeddings: DataFrame) -> DataFrame:
    """``vec_id, blob, same``: each vector in base64, and whether it comes back unchanged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blobs = [encode(v) for v in batch["embedding"]]
            same = [bool(np.array_equal(decode(b, len(v))[0], np.asarray(v, "<f4"))) for b, v in zip(blobs, batch["embedding"])]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "blob": blobs, "same": same})

    return embeddings.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, blob string, same boolean")
