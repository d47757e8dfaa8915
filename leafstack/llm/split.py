"""Splitting oversized texts at natural boundaries, with an overlap between pieces.

Recursive separator hierarchy: a text is cut into sections, a part that is still too large
into paragraphs, then sentences, words and at last characters; the parts are packed greedily
up to the limit and every piece after the first starts ``overlap`` characters before the end
of the piece before it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: The hierarchy, coarse to fine. A match ends a part; what it matches stays with that part.
LEVELS: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("section", re.compile(r"\n[ \t]*\n\s*(?=\[Sheet: |#{1,6} |[^\W\d_][^\n.!?;:,|]{1,58}\n[ \t]*\n)|\f")),
    ("paragraph", re.compile(r"\n[ \t]*\n\s*")),
    ("sentence", re.compile(r"[.!?…][\"'”’»)\]]*\s+|(?<=[。！？])|\n(?=\s*(?:[-•*]|\d+[.)])\s)|;\s")),
    ("word", re.compile(r"\s+")),
)

PIECES = "piece_index int, start int, end int, boundary string, piece string"


def _char_end(text: str, start: int, end: int) -> int:
    """``end`` moved back so that no combining mark or joined sequence is torn off its base."""
    at = end
    while at > start + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at if at > start + 1 else end


def _atoms(text: str, start: int, end: int, most: int, level: int) -> Iterator[tuple[int, str]]:
    """Ends of parts of at most ``most`` characters, each with the level of its boundary."""
    if end - start <= most:
        yield end, LEVELS[level - 1][0] if level else "end"
        return
    if level == len(LEVELS):
        while end - start > most:
            cut = _char_end(text, start, start + most)
            yield cut, "character"
            start = cut
        yield end, LEVELS[-1][0]
        return
    name, pattern = LEVELS[level]
    at = start
    for m in pattern.finditer(text, start, end):
        if start < m.end() < end and m.end() > at:
            yield from _named(_atoms(text, at, m.end(), most, level + 1), m.end(), name)
            at = m.end()
    yield from _named(_atoms(text, at, end, most, level + 1), end, LEVELS[level - 1][0] if level else "end")


def _named(parts: Iterator[tuple[int, str]], end: int, name: str) -> Iterator[tuple[int, str]]:
    for at, level in parts:
        yield (at, name) if at == end else (at, level)


RANK = {"end": 0, "section": 1, "paragraph": 2, "sentence": 3, "word": 4, "character": 5}


def split_offsets(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, end, boundary)`` of the pieces of ``text``; offsets in code points.

    A text of at most ``size`` characters is one piece. ``overlap`` is held between 0 and
    ``size - 1``; every later piece shares exactly that many characters with the one before.
    """
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if len(text) <= size:
        return [(0, len(text), "end")]
    overlap = min(max(overlap, 0), size - 1)
    most = size - overlap
    pieces: list[tuple[int, int, str]] = []
    start = last = 0
    best = "end"
    for end, level in _atoms(text, 0, len(text), most, 0):
        if end - start > size:
            pieces.append((start, last, best))
            start = max(last - overlap, start + 1)
        last, best = end, level
    pieces.append((start, last, "end"))
    return pieces


def split_texts(docs: DataFrame, settings: DataFrame, text: str = "full_text", key: str = "doc_id", kind: str = "file_type") -> DataFrame:
    """Pieces of every text of ``docs`` under the limit of its ``kind``.

    ``settings`` has one row per ``kind`` with ``chunk_size`` and ``chunk_overlap``; the first by
    size counts where a kind stands twice. Returns ``key, piece_index, start, end, boundary, piece,
    n_pieces``. Null texts give no row, an empty text one empty piece. Where a kind is missing in
    ``settings`` or its size is null or not positive, the text comes out whole. Rows are
    independent of each other: one pass over the input, no shuffle. Columns of ``docs`` beyond the
    three named are not touched, so their names cannot clash.
    """
    rules = settings.select(F.col(kind).alias("__kind"), F.col("chunk_size").cast("int").alias("__size"), F.coalesce(F.col("chunk_overlap").cast("int"), F.lit(0)).alias("__overlap"))
    rules = rules.where("__size > 0").groupBy("__kind").agg(F.min_by(F.struct("__size", "__overlap"), F.struct("__size", "__overlap")).alias("__rule"))
    source = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(kind).alias("__kind"), F.col(text).alias("__text"))
    joined = source.join(rules, "__kind", "left").select("__key", "__text", F.col("__rule.__size").alias("__size"), F.col("__rule.__overlap").alias("__overlap"))
    kind_of_key = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for k, t, size, overlap in zip(batch["__key"], batch["__text"], batch["__size"], batch["__overlap"]):
                cuts = split_offsets(t, int(size), int(overlap)) if size == size and size is not None else [(0, len(t), "end")]
                out.extend((k, i, s, e, b, t[s:e], len(cuts)) for i, (s, e, b) in enumerate(cuts))
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)

    return joined.mapInPandas(run, f"__key {kind_of_key}, {PIECES}, n_pieces int").withColumnRenamed("__key", key)


COLUMNS = ["__key", "piece_index", "start", "end", "boundary", "piece", "n_pieces"]
