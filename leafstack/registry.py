"""Named operators under one contract, and the pipeline that runs a document table through them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from leafstack.functions import text as T
from leafstack.operators import chunking, classify, evaluate, questions, reports, retrieval, store, summarize, tables, vectors
from leafstack.session import materialize


@dataclass(frozen=True)
class Operator:
    """An operator on a table: what it does, and the columns it cannot do without."""

    name: str
    apply: Callable[..., DataFrame]
    required: tuple[str, ...] = ()
    description: str = ""


@dataclass
class Outcome:
    """What came of a run: a table, or why there is none."""

    name: str
    result: DataFrame | None = None
    error: str | None = None
    seconds: float = 0.0
    warnings: list[str] = field(default_factory=list)

    @property
    def success(self) -> bool:
        return self.error is None


OPERATORS: dict[str, Operator] = {}


def register(name: str, operator: Callable[..., DataFrame], required: tuple[str, ...] = ()) -> None:
    """Adds an operator; a name is given once."""
    if name in OPERATORS:
        raise ValueError(f"operator {name} exists")
    OPERATORS[name] = Operator(name, operator, required, (operator.__doc__ or "").strip().split("\n")[0])


def missing(name: str, rows: DataFrame) -> list[str]:
    """The columns an operator requires that ``rows`` lacks."""
    return [c for c in OPERATORS[name].required if c not in rows.columns]


def run(name: str, rows: DataFrame, *args, act: bool = False, **options) -> Outcome:
    """Runs an operator: an unknown name, a missing column or an exception becomes the outcome's error.

    Tables are lazy; with ``act`` the result is written once, so that the time and errors are those of the work itself.
    """
    began = time.monotonic()
    out = Outcome(name)
    try:
        if name not in OPERATORS:
            raise ValueError(f"no operator {name}")
        if lacking := missing(name, rows):
            raise ValueError(f"{name} needs the columns {', '.join(lacking)}")
        made = OPERATORS[name].apply(rows, *args, **options)
        out.result = materialize(made, name) if act else made
    except Exception as e:  # a failed operator is an outcome, not the end of a run
        out.error = f"{type(e).__name__}: {e}".split("\n")[0]
    out.seconds = time.monotonic() - began
    return out


register("question_extraction", questions.extract, ("doc_id",))
register("question_dedup", questions.greedy_distinct, ("doc_id", "pos", "question"))
register("structured_extraction", reports.entities, ("doc_id",))
register("summarization", summarize.extractive, ("doc_id", "text"))
register("document_classifier", classify.scored, ("doc_id",))
register("passages", chunking.passages, ("text",))
register("page_offsets", chunking.page_offsets, ("doc_id", "chunk_index", "text"))
register("sections", chunking.sections, ("doc_id",))
register("section_chunks", chunking.section_chunks, ("doc_id",))
register("boundary_chunks", chunking.boundary_chunks, ("doc_id",))
register("keyword_scores", retrieval.keyword_scores, ("q_id", "question"))
register("vector_top", retrieval.vector_top, ("q_id", "embedding"))
register("select_context", retrieval.select_context, ("q_id", "pos", "score"))
register("citations", reports.citations, ("result_id", "summary"))
register("sheet_headers", tables.headers, ("doc_id", "chunk_index", "text"))
register("sheet_edits", tables.apply_edits, ("sheet", "row", "column", "value"))
register("stored_vectors", vectors.passage_vectors, ("id", "content_chunks_json", "content_embeddings_b64", "embedding_model", "chunk_scheme"))
register("result_json", store.result_json, ("result_id",))
register("display_names", store.display_names, ("id", "file_name", "created_at"))
register("answer_ranks", evaluate.answer_ranks, ("q_id", "doc_id", "score", "pos"))


def analyse(docs: DataFrame, text: str = "full_text", sentences: int = 15, domain: Column | str | None = None) -> DataFrame:
    """One row per document with cleaned text, verdict, plan, summary, questions and entities.

    The cleaned text is written once. Stages are gated by the plan before they run, so a document that needs no questions is not
    searched for any. ``domain`` is a column of ``docs`` or an expression over them; without it, or where it is null, the domain is General.
    Null texts come out with nulls.
    """
    named = F.lit("General") if domain is None else F.coalesce(F.col(domain) if isinstance(domain, str) else domain, F.lit("General"))
    base = materialize(docs.select("doc_id", "file_name", "file_type", named.alias("domain"), T.clean(F.col(text)).alias("text")), "cleaned")
    scores = classify.scored(base, "text")
    planned = base.join(scores, "doc_id", "left").withColumn("doc_type", classify.verdict(F.coalesce("score", F.lit(0.0))))
    planned = planned.withColumn("plan", classify.stage_plan(F.col("file_type"), F.col("doc_type"), F.col("domain"), F.col("file_type") == "excel"))
    planned = materialize(planned, "planned")
    summary = summarize.extractive(base, sentences)
    asked = questions.greedy_distinct(questions.extract(planned.where(F.array_contains("plan", "question_extraction")), "text"))
    found = reports.entities(planned.where(F.array_contains("plan", "structured_extraction")), "text")
    return planned.join(summary, "doc_id", "left").join(asked, "doc_id", "left").join(found, "doc_id", "left")
