"""Extractive summaries by word frequency, position and length."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leafstack.functions import text as T
from leafstack.session import spread

#: Sentences of a whole text, fewest of a section, and the longest summary.
SENTENCES, FEWEST, LONGEST = 15, 2, 4000
END = re.compile(r"(?<=[.!?])[\t\n\x0b\f\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WORD = re.compile(r"\w+")
STOP = frozenset(T.SENTENCE_STOPWORDS)
MILLIONTH = Decimal("0.000001")


def terms(text: str) -> list[str]:
    """The terms of :func:`leafstack.functions.text.term_list`."""
    return [w for w in WORD.findall(text.lower()) if len(w) > 2 and w not in STOP and w.isascii() and w.isalpha()]


def best_sentences(text: str, n: int) -> list[str]:
    """The ``n`` best sentences of a text in their order.

    A sentence scores the mean frequency of its words in the text, more at its begin and end and at a usual length;
    ties go to the later sentence.
    """
    found = [x for x in (part.strip() for part in END.split(text)) if len(x) > 25]
    counts = Counter(terms(text))

    def score(i: int) -> Decimal:
        own = terms(found[i])
        mean = sum(counts[w] for w in own) / (len(own) + 1)
        place = 1.2 if i / len(found) < 0.1 or i / len(found) > 0.9 else 1.0
        return Decimal(repr(mean * place * (1.1 if 40 < len(found[i]) < 200 else 0.9))).quantize(MILLIONTH, ROUND_HALF_UP)

    best = heapq.nlargest(n, ((score(i), i) for i in range(len(found))))
    return [found[i] for i in sorted(i for _, i in best)]


def extractive(docs: DataFrame, n: int | str = SENTENCES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, summary, picked``: the best ``n`` sentences of each text; ``n`` is a number or a column's name.

    Null texts and texts without a sentence give no row. The mean over a text's own counts is a fold within the row, so an Arrow function; no shuffle of the
    texts but where the table has fewer parts than the cluster has cores.
    """
    most = (F.lit(n) if isinstance(n, int) else F.col(n)).cast("int")
    rows = spread(docs.where(F.col("text").isNotNull()).select(*keys, F.col("text").alias("__text"), most.alias("__most")))
    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            picked = [best_sentences(t, m) for t, m in zip(batch["__text"], batch["__most"])]
            made = batch[list(keys)].assign(summary=[" ".join(x) for x in picked], picked=[len(x) for x in picked])
            yield made[made["picked"] > 0]

    return rows.mapInPandas(run, f"{kept}, summary string, picked bigint")


def by_section(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc_id, summary``: the best sentences of every section under its heading, or of the whole text where there are no sections; cut to 4000 characters.

    ``sections`` has ``doc_id, section_no, heading, body``. The more sections, the fewer sentences of each, but two at least.
    """
    counts = sections.groupBy("doc_id").agg(F.greatest(F.lit(FEWEST), F.floor(F.lit(SENTENCES) / F.count("*"))).alias("n"))
    rows = sections.withColumnRenamed("body", "text").join(counts, "doc_id")
    parts = extractive(rows, "n", ("doc_id", "section_no", "heading"))
    block = F.concat(F.lit("**"), "heading", F.lit("**\n"), "summary")
    made = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", block.alias("b")))).alias("x"))
    made = made.select("doc_id", F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("summary"))
    flat = extractive(docs.join(made.select("doc_id"), "doc_id", "left_anti")).select("doc_id", "summary")
    return made.unionByName(flat).withColumn("summary", F.left("summary", F.lit(LONGEST)))
