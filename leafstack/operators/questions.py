"""Questions of a document: patterns, adjacent lines, near-duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafstack.functions import text as T

#: What counts as a question (pattern, group), in the order in which findings are listed.
PATTERNS: tuple[tuple[str, str, int], ...] = (
    ("ends_question", r"(?m)(?:^|\n)[ \t]*(?:[0-9]+[.)][ \t]*)?([A-Z][^\n]{8,200}\?)", 1),
    ("q_prefix", r"(?im)^[ \t]*(?:q(?:uestion)?[\s.\-]*(?:[0-9]+|[ivxlc]+)[.):\-]?\s*)(.{5,200})$", 1),
    ("numbered_instruction", r"(?im)^[ \t]*(?:[0-9]{1,3}[.)]\s+)([A-Z][^\n]{10,200}(?:select|choose|rate|rank|describe|explain|list|provide|indicate|specify|identify|state|outline|comment|assess|evaluate|mention|complete|fill|write|do you|would you|have you|are you|can you|will you|should|did you)[^\n]{3,})", 1),
    ("please", r"(?im)^[ \t]*(?:please\s+(?:select|choose|rate|rank|describe|explain|list|provide|indicate|specify|identify|state|outline|comment|assess|fill\s+in|write|check|tick|mark|circle).{5,200})$", 0),
    ("rating", r"(?im)^[ \t]*((?:rate|on\s+a\s+scale|how\s+(?:likely|often|satisfied|well|much|many|would)\b)[^\n]{5,200})$", 1),
    ("yes_no", r"(?im)^[ \t]*([0-9]+[.)]\s*)?([A-Z][^\n]{8,150}?)[\s\n]+(?:\(\s*Yes\s*\)|\bYes\b).*(?:\(\s*No\s*\)|\bNo\b)", 2),
    ("section_question", r"(?m)^[ \t]*\*{1,2}([A-Z][^\n*]{5,80}\?)\*{0,2}[ \t]*$", 1),
    ("field_label", r"(?m)^[ \t]*([A-Z][A-Za-z\s/()]{2,60}?)\s*(?:[*:])\s*(?:_{3,}|\[[\s_]+\]|\(\s*\)|required|optional|____)?[ \t]*$", 1),
    ("likert", r"(?im)^[ \t]*(.{10,200}?)\s*\n[ \t]*(?:strongly\s+agree|very\s+satisfied|always|never|1\s*[-–]\s*5)", 1),
)
#: Fixed value: an answer option.
ANSWER = r"(?i)^[ \t]*([a-e][.)][ \t]|[①②③④⑤]|\([ \t]*[a-e][ \t]*\)|(strongly agree|strongly disagree|agree|disagree|neutral|very (satisfied|dissatisfied)|not applicable|n/?a|always|usually|sometimes|rarely|never|yes|no|true|false|other)[ \t]*$)"
LEAST, MOST_QUESTIONS, SAME = 4, 200, 0.72


def is_answer_option(c: Column) -> Column:
    return c.rlike(ANSWER)


def extract(docs: DataFrame, text: str) -> DataFrame:
    """``doc_id, pos, question``: all findings of all patterns, then the questions over two lines, cleaned, without answer options.

    Null texts give none. One pass, no shuffle. The cap on a document's questions comes after duplicates are removed (:func:`greedy_distinct`).
    """
    c = F.col(text)
    found = F.concat(*(F.regexp_extract_all(c, F.lit("(?dU)" + p), F.lit(g)) for _, p, g in PATTERNS), two_lines(c))
    kept = F.filter(F.transform(found, T.strip), lambda q: (F.length(q) >= LEAST) & ~is_answer_option(q))
    cleaned = F.filter(F.transform(kept, T.clean_question), lambda q: F.length(q) >= LEAST)
    return docs.where(c.isNotNull()).select("doc_id", F.posexplode(cleaned).alias("pos", "question"))


def runs_on(line: Column, after: Column) -> Column:
    """Whether a line starts upper case without an end mark and the next one ends with a question mark."""
    return line.rlike("^[A-Z]") & ~line.rlike("[.?!:,;]$") & after.endswith("?") & (F.length(line) > 10) & (F.length(F.concat(line, after)) < 250)


def two_lines(c: Column) -> Column:
    """The questions of a text that run over two lines, in order."""
    lines = F.transform(F.split(c, "\n"), T.strip)
    pairs = F.arrays_zip(F.slice(lines, F.lit(1), F.size(lines) - 1).alias("a"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("b"))
    return F.transform(F.filter(pairs, lambda x: runs_on(x["a"], x["b"])), lambda x: F.concat_ws(" ", x["a"], x["b"]))


def joined_lines(docs: DataFrame, text: str) -> DataFrame:
    """``doc_id, pos, question``: questions that run over two lines, with the number of the first."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.strip(F.col("line")).alias("line"))
    with_next = lines.withColumn("nxt", F.lead("line").over(W.partitionBy("doc_id").orderBy("pos")))
    return with_next.where(runs_on(F.col("line"), F.col("nxt"))).select("doc_id", "pos", F.concat_ws(" ", "line", "nxt").alias("question"))


def greedy(found: list[str]) -> list[str]:
    """One of each group of near-equal questions, in order of the first.

    A question belongs to the kept one that shares the largest part of its words (the earliest of several), if that part is at least
    SAME; the longer text of the two then stands for the group.
    """
    texts: list[str] = []
    bags: list[frozenset[str]] = []
    where: dict[str, list[int]] = {}  # kept questions by word
    for q in found:
        bag = frozenset(q.lower().strip().rstrip("?. ").split())
        met = sorted({i for w in bag for i in where.get(w, ()) if w in bags[i]})
        alike = [len(bag & bags[i]) / len(bag | bags[i]) for i in met]
        best = max(alike, default=0.0)
        if best < SAME:
            at = len(texts)
            texts.append(q)
            bags.append(bag)
        elif len(q) > len(texts[at := met[alike.index(best)]]):
            texts[at], bags[at] = q, bag
        for w in bags[at]:
            if at not in where.setdefault(w, []):
                where[w].append(at)
    return texts


def greedy_distinct(found: DataFrame) -> DataFrame:
    """``doc_id, questions`` after greedy removal of near-duplicates, at most MOST_QUESTIONS. Order-dependent, so a fold within each document."""
    grouped = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "question"))).alias("q"))
    rows = grouped.select("doc_id", F.transform("q", lambda x: x["question"]).alias("q"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "questions": [greedy(list(q))[:MOST_QUESTIONS] for q in batch["q"]]})

    return rows.mapInPandas(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, questions array<string>")
