"""Passages, windows, page offsets, sections and packed chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from leafstack.functions import text as T
from leafstack.operators.running import running_sum

#: The smallest text that is cut, and the headings of a document.
WHOLE_BELOW = 40
HEADINGS = (
    re.compile(r"^#{1,4}\s+(.+)$", re.M),
    re.compile(r"^\d+(?:\.\d+)*\s{1,4}([A-Z][^\n]{2,70})$", re.M),
    re.compile(r"^([A-Z][A-Z0-9\s\-:]{4,60}[A-Z0-9])$", re.M),
    re.compile(r"^([A-Z][a-zA-Z0-9\s\-]{3,60})\s*\n[=\-]{4,}", re.M),
    re.compile(r"^(?:Section|Chapter|Part|Article)\s+\d+[:.\s]+(.+)$", re.M | re.I),
)
#: Where a chunk may end, best first.
BREAKS = ("\n\n", ".\n", ". ", "? ", "! ", "; ")


def sliding(tokens: Column, size: int, overlap: int) -> Column:
    """Array of windows of ``size`` items of an array, each starting ``size - overlap`` after the one before."""
    overlap = overlap if overlap < size else size // 5
    step = size - overlap
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.slice(tokens, i * step + 1, F.lit(size)))


def passages(chunks: DataFrame, size: int = 100, overlap: int = 20) -> DataFrame:
    """Chunks cut into overlapping word windows: ``passage_index`` and ``passage`` beside all columns.

    A text of at most ``max(size, 40)`` words stays as it is, an empty or null one too. Row-wise, no shuffle.
    """
    tokens = T.words(F.col("text"))
    cut = F.when(F.coalesce(F.size(tokens), F.lit(0)) <= max(size, WHOLE_BELOW), F.array(F.coalesce("text", F.lit("")))).otherwise(F.transform(sliding(tokens, size, overlap), lambda w: F.array_join(w, " ")))
    return chunks.select("*", F.posexplode(cut).alias("passage_index", "passage"))


def char_windows(docs: DataFrame, text: str, size: int = 5000, overlap: int = 200) -> DataFrame:
    """Fixed character windows; the whole text if short; a null text gives no row."""
    c = F.col(text)
    step = size - overlap
    starts = F.sequence(F.lit(0), F.when(F.length(c) <= size, 0).otherwise(F.ceil((F.length(c) - size) / step)).cast("int"))
    return docs.select("*", F.posexplode(F.transform(starts, lambda i: c.substr(i * step + 1, F.lit(size)))).alias("window_index", "window")).drop(text)


def fixed_slices(docs: DataFrame, text: str, size: int = 1000) -> DataFrame:
    """Slices of ``size`` characters numbered from 1; at least one, which may be empty."""
    c = F.coalesce(F.col(text), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / size).cast("int") - 1, F.lit(0)))
    return docs.select("*", F.posexplode(F.transform(starts, lambda i: c.substr(i * size + 1, F.lit(size)))).alias("p", "slice")).withColumn("slice_no", F.col("p") + 1).drop("p", text)


def page_offsets(chunks: DataFrame) -> DataFrame:
    """Start and end of every non-blank chunk in the text that the chunks of its document join up to."""
    full = chunks.where(F.coalesce(T.strip(F.col("text")), F.lit("")) != "").withColumn("__n", F.length("text") + 2)
    ends = running_sum(full, "doc_id", "chunk_index", "__n", "__end")
    return ends.withColumn("start_at", F.col("__end") - F.col("__n")).withColumn("end_at", F.col("__end") - 2).drop("__n", "__end")


def page_overlap(offsets: DataFrame, size: int = 4000) -> DataFrame:
    """Pages that each fixed slice of a document's text overlaps: an interval join kept within the document.

    Pages are cut at the slice borders they cross, so the join is an equi-join on (document, slice).
    """
    cells = F.sequence(F.floor(F.col("start_at") / size).cast("int"), F.floor((F.col("end_at") - 1) / size).cast("int"))
    return offsets.where("end_at > start_at").select("doc_id", F.explode(cells).alias("slice"), "chunk_index").groupBy("doc_id", "slice").agg(F.array_sort(F.collect_set("chunk_index")).alias("pages"))


def boundary_offsets(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of at most ``size`` that end behind a break; the next starts ``overlap`` before that end.

    Of the kinds of break in BREAKS the first that has one behind the chunk's overlap decides, and of its breaks the last; without any
    the chunk is full. The breaks of a text are looked up once, then found by bisection.
    """
    places = [[m.end() + len(b) - 1 for m in re.finditer(f"{re.escape(b[0])}(?={re.escape(b[1:])})", text)] for b in BREAKS]

    def cut(first: int) -> int:
        full = first + size
        if full >= len(text):
            return len(text)
        for b, ends in zip(BREAKS, places):
            last = bisect_right(ends, full) - 1
            if last >= 0 and ends[last] - len(b) >= first + overlap:
                return ends[last]
        return full

    out = [(0, cut(0))] if text else []
    while out and out[-1][1] < len(text):
        first = max(out[-1][0] + 1, out[-1][1] - overlap)
        out.append((first, cut(first)))
    return out


def find_sections(text: str) -> list[tuple[str, str]]:
    """Headings with the text up to the next one; overlapping matches and empty bodies are left out."""
    found = sorted((m.start(), m.end(), (m.group(m.lastindex or 0) or m.group()).strip()) for p in HEADINGS for m in p.finditer(text))
    heads: list[tuple[int, int, str]] = []
    for start, end, name in found:
        if len(name) > 3 and (not heads or start >= heads[-1][1]):
            heads.append((start, end, name))
    out = []
    for i, (_, end, name) in enumerate(heads):
        body = text[end : heads[i + 1][0] if i + 1 < len(heads) else len(text)].strip()
        if body:
            out.append((name, body))
    return out


def pack_sections(sections: list[tuple[str, str]], size: int, overlap: int) -> list[str]:
    """Sections under their headings, filled into chunks of about ``size``; a chunk of more than one and a half times that is cut at boundaries afterwards."""
    packed: list[list[str]] = []
    room = 0
    for block in (f"## {name}\n\n{body}" for name, body in sections):
        if packed and len(block) <= room:
            packed[-1].append(block)
            room -= len(block) + 2
        else:
            packed.append([block])
            room = size - len(block)
    whole = ("\n\n".join(blocks).strip() for blocks in packed)
    return [part for chunk in whole for part in ([chunk[a:b] for a, b in boundary_offsets(chunk, size, overlap)] if len(chunk) > 1.5 * size else [chunk])]


def _mapped(docs: DataFrame, text: str, make, schema: str) -> DataFrame:
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch["doc_id"], batch["t"]) if t for r in make(t)]
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    return docs.select("doc_id", F.col(text).alias("t")).mapInPandas(run, f"doc_id {key}, {schema}")


def boundary_chunks(docs: DataFrame, text: str, size: int = 4000, overlap: int = 300) -> DataFrame:
    """Boundary-aware chunks. Data-dependent recurrence within one text, so an Arrow batch function; null and empty texts give none."""
    return _mapped(docs, text, lambda t: [(i, a, b, t[a:b]) for i, (a, b) in enumerate(boundary_offsets(t, size, overlap))], "chunk_no int, start_at int, end_at int, chunk string")


def sections(docs: DataFrame, text: str) -> DataFrame:
    """Sections of each text; texts without headings give none."""
    return _mapped(docs, text, lambda t: [(i, h, b) for i, (h, b) in enumerate(find_sections(t))], "section_no int, heading string, body string")


def section_chunks(docs: DataFrame, text: str, size: int = 4000, overlap: int = 300) -> DataFrame:
    """Sections packed into chunks; texts without headings are cut at boundaries."""
    def make(t: str) -> list[tuple[int, str]]:
        found = find_sections(t)
        return list(enumerate(pack_sections(found, size, overlap) if found else [t[a:b] for a, b in boundary_offsets(t, size, overlap)]))

    return _mapped(docs, text, make, "chunk_no int, chunk string")
