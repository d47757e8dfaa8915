"""Workbooks, read and written with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_SHEETS, MOST_ROWS = 50, 10_000


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(data: bytes, most_sheets: int = MOST_SHEETS, most_rows: int = MOST_ROWS) -> list[tuple[str, list[list[str]]]]:
    """Sheets of a workbook: name and rows of text cells; rows without a value are left out.

    ``most_sheets`` and ``most_rows`` are the reader's limits (a feature: they keep one broken file from filling a task).
    """
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))[:most_sheets]:
            target = targets[sheet.get(_REL)].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(book.read(path)).iter(f"{_MAIN}row"):
                cells: list[str] = []
                for n, c in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else n
                    cells += [""] * (at + 1 - len(cells))
                    value = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")).strip()
                    elif value is not None and value.text is not None:
                        cells[at] = (shared[int(value.text)] if c.get("t") == "s" else value.text).strip()
                if any(cells):
                    rows.append(cells)
                if len(rows) >= most_rows:
                    break
            out.append((sheet.get("name"), rows))
        return out


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A workbook with inline text cells."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
