"""Files of any kind as documents and chunks.

``binaryFile`` lists and reads; one Arrow batch function parses. A file that cannot be read gives a row with ``error``; it never fails the job.
PDF, OCR and speech need libraries or services that are injected: ``readers`` maps a route to a function from bytes to chunks.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafstack.operators import store
from leafstack.sources.xlsx import read_workbook

#: A chunk: page number or None, sheet name or None, text.
Chunk = tuple[int | None, str | None, str]
Reader = Callable[[bytes], list[Chunk]]
CSV_ENCODINGS = ("utf-8", "cp1252", "latin-1")
#: Rows of a long sheet that are written out: the first and last ones.
SHEET_WHOLE, SHEET_EDGE, MOST_COLUMNS = 600, 300, 30


def looks_like_header(row: list[str]) -> bool:
    """Whether under half of the filled cells are numbers."""
    filled = [c for c in row if c.strip()]
    return bool(filled) and sum(c.strip().translate(str.maketrans("", "", ".,-")).isdigit() for c in filled) / len(filled) < 0.5


def sheet_text(name: str, rows: list[list[str]]) -> str:
    """A sheet as text: its name, number of rows and columns, then the rows, of long sheets the first and last."""
    head, body = (rows[0], rows[1:]) if rows and looks_like_header(rows[0]) else ([f"col_{i}" for i in range(max(map(len, rows), default=0))], rows)
    head = [c or f"col_{i}" for i, c in enumerate(head)][:MOST_COLUMNS]
    lines = [" | ".join(r[:MOST_COLUMNS]) for r in body]
    if len(lines) > SHEET_WHOLE:
        lines = [*lines[:SHEET_EDGE], f"... {len(lines) - 2 * SHEET_EDGE} rows omitted ...", *lines[-SHEET_EDGE:]]
    return "\n".join([f"[Sheet: {name}]", f"- Total Rows: {len(body)}", f"- Columns: {', '.join(head)}", "", " | ".join(head), *lines])


def read_excel(data: bytes) -> list[Chunk]:
    return [(None, name, sheet_text(name, rows)) for name, rows in read_workbook(data) if rows]


def read_csv(data: bytes, most_rows: int = 10_000) -> list[Chunk]:
    """One chunk; encodings are tried in order."""
    for encoding in CSV_ENCODINGS:
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    rows = [r for r, _ in zip((r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)), range(most_rows + 1))]
    return [(1, "CSV", sheet_text("CSV", rows))] if rows else []


def read_pdf(data: bytes) -> list[Chunk]:
    """Pages of a PDF by whichever engine is installed."""
    try:
        import pdfplumber
    except ImportError:
        import fitz

        return [(i, None, page.get_text()) for i, page in enumerate(fitz.open(stream=data, filetype="pdf"), 1)]
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return [(i, None, page.extract_text() or "") for i, page in enumerate(pdf.pages[:500], 1)]


SCHEMA = "path string, file_name string, file_type string, file_hash string, chunk_index int, page_no int, sheet_name string, text string, error string"


def read_files(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None, glob: str = "*") -> DataFrame:
    """Chunks of all files under ``path``: one row per page, sheet or transcript, or one with ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return parse_files(files, readers)


def parse_files(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """The same for rows of the ``binaryFile`` format, streaming or not."""
    known: dict[str, Reader] = {"pdf": read_pdf, "excel": read_excel, "csv": read_csv} | (readers or {})
    name = F.regexp_extract("path", "[^/]+$", 0)
    rows = files.select("path", name.alias("file_name"), store.route(name).alias("file_type"), store.validate(name, F.col("length")).alias("fault"), F.sha2("content", 256).alias("file_hash"), F.when(store.validate(name, F.col("length")).isNull(), F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, n, kind, fault, digest, content in batch.itertuples(index=False):
                try:
                    if fault:
                        raise ValueError(fault)
                    chunks = known["csv" if n.lower().endswith(".csv") else kind](content)
                    out += [(p, n, kind, digest, i, page, sheet, text, None) for i, (page, sheet, text) in enumerate(chunks)] or [(p, n, kind, digest, None, None, None, None, "empty")]
                except Exception as e:  # a bad file is a row, not a failed job
                    out.append((p, n, kind, digest, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"chunk_index": "Int32", "page_no": "Int32"})

    return rows.mapInPandas(run, SCHEMA)
