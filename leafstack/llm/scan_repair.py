"""Traces of scanning in page texts: finding them and repairing the text into continuous paragraphs.

Words broken across lines, misread characters inside words, running headers and footers, and page numbers.
Misreadings are corrected against the corpus itself: words are counted over all pages; a symmetric-delete index over
the frequent words (keys folded by the usual confusions) is joined with the rare words; a weighted edit
distance over confusion pairs and the counts decide whether a rare word is a misreading, and the
counts of neighbouring words pick the repair.
"""

from __future__ import annotations

import itertools
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafstack.session import materialize

#: What is printed, and what it is misread as.
CONFUSIONS = (("l", "1"), ("l", "i"), ("l", "|"), ("i", "1"), ("i", "!"), ("i", "|"), ("i", "l"), ("o", "0"), ("s", "5"), ("g", "9"), ("b", "6"), ("b", "8"), ("a", "@"), ("e", "c"), ("t", "f"), ("s", "$"), ("z", "2"), ("fi", "ﬁ"), ("fl", "ﬂ"))
#: Readings of more than one letter, with what may stand for their strokes, and the same read the other way.
LONG = tuple((t, "".join(v)) for t, r in (("m", "rn"), ("m", "iii"), ("d", "cl"), ("n", "ri"), ("u", "ii"), ("ü", "ii"), ("h", "li"), ("w", "vv"), ("k", "lc")) for v in itertools.product(*({"i": "i1!|l", "l": "l1|!i"}.get(c, c) for c in r)))
BACK = (("rn", "m"), ("cl", "d"), ("ri", "n"), ("li", "h"), ("vv", "w"), ("ii", "u"))
PAIRS: dict[str, tuple[tuple[str, str], ...]] = {}
for _t, _r in dict.fromkeys((*CONFUSIONS, *LONG, *BACK)):
    PAIRS[_t[0]] = (*PAIRS.get(_t[0], ()), (_t, _r))
#: Every letter as the strokes it can fall apart into, so that all readings of a word share one key.
_STROKES = str.maketrans({"1": "l", "|": "l", "!": "l", "i": "l", "0": "o", "5": "s", "$": "s", "9": "g", "6": "b", "8": "b", "@": "a", "c": "e", "f": "t", "2": "z", "m": "rrl", "n": "rl", "d": "el", "u": "ll", "ü": "ll", "h": "ll", "w": "vv", "k": "le", "ﬁ": "tl", "ﬂ": "tl"})
#: Cells of the hashed table of neighbouring words, and bits of the filter of words that have a correction.
PAIR_CELLS, FILTER_BITS = 1 << 21, 1 << 25
#: A word counts as frequent from here on; a misreading is at most this share of its word (beyond one).
FREQUENT, SHARE = 3, 0.01
#: A plain substitution of one letter counts as a misreading in words of this many letters, beside a word this many times as frequent, whose neighbours it stands among.
PLAIN_LETTERS, PLAIN_RATIO, PLAIN_SUPPORT = 7, 200, 3
#: Pages of a document on which a running header stands at least, on average over the documents that have it.
HEAD_PAGES = 1.5

#: A word with what may be misread inside it. Codes and file names are parts of longer runs and are skipped.
RUN = re.compile(r"\S+")
CORE = re.compile(r"[^\W\d_](?:[^\W_]|[|!@$])*[^\W_]|[0156|!@$](?:[^\W_]|[|!@$])*[^\W\d_]", re.U)
TRIM = "“”„‚«»‹›()[]{}.,;:?\"'…*–—"
BREAK = re.compile(r"([^\W\d_]+)([-­‐‑¬])[ \t]*\n[ \t]*([^\W\d_]+)")
SUSPENDED = {"and", "or", "und", "oder", "bis", "y", "o", "e", "et", "ou", "sowie", "to", "u"}
PAGE_WORDS = r"(?:page|pagina|página|pagine|seite|blatt|p\.?|s\.?|pg\.?|pág\.?)"
DIGITS = r"[0-9lIO|!oS]{1,4}"
PAGE_LINE = re.compile(rf"^\W*(?:{PAGE_WORDS}\s*)?({DIGITS}|[ivxl]{{1,7}})(?:\s*(?:/|of|von|sur|de|di)\s*{DIGITS})?\W*$", re.I)
HEAD_NUMBER = re.compile(rf"^\s*({DIGITS})\s*[|·•]\s+(?=\S)|(?<=\S)(?:\s{{3,}}|\s*[|·•]\s*)({DIGITS})\s*$")
HEAD_FORM = re.compile(r"^[^\s/]+ / \S+$|^\S.*\S {3,}\S.*\S$|^[^–\n]{8,70} – [^\W\d_][\w@|!]+$")


def fold(word: str) -> str:
    """Key under which a word and its usual misreadings agree."""
    return word.lower().translate(_STROKES)


def deletes(key: str) -> set[str]:
    """A folded key and its single deletions (of keys of five and more)."""
    return {key} | ({key[:i] + key[i + 1 :] for i in range(len(key))} if len(key) >= 5 else set())


def distance(true: str, read: str, most: float = 2.4) -> float:
    """Weighted edit distance from a printed word to what was read: 0.4 a confusion, 2 any other edit."""
    a, b = true, read
    if abs(len(a) - len(b)) > 4:
        return 9.0
    inf = 9.0
    rows = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    rows[0][0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d = rows[i][j]
            if d > most:
                continue
            if i < len(a) and j < len(b):
                if a[i] == b[j]:
                    rows[i + 1][j + 1] = min(rows[i + 1][j + 1], d)
                rows[i + 1][j + 1] = min(rows[i + 1][j + 1], d + 2.0)
            if i < len(a):
                rows[i + 1][j] = min(rows[i + 1][j], d + 2.0)
            if j < len(b):
                rows[i][j + 1] = min(rows[i][j + 1], d + 2.0)
            for t, r in PAIRS.get(a[i], ()) if i < len(a) else ():
                if b.startswith(r, j) and a.startswith(t, i):
                    k, m = i + len(t), j + len(r)
                    rows[k][m] = min(rows[k][m], d + 0.4)
    return rows[len(a)][len(b)]


def run_words(run: str) -> tuple[tuple[int, int, str], ...]:
    """Words that can be judged in a run without white space: Latin letters, with what may stand for one. Codes, file names and wrongly decoded words are left out."""
    left = len(run) - len(run.lstrip(TRIM))
    core = run.strip(TRIM)
    if not core:
        return ()
    out, at = [], left
    for part in re.split(r"([-’'/‐­¬])", core):
        if part and CORE.fullmatch(part) and not ("." in core or "_" in core) and part.isascii() | all(c.isalnum() or c in "|!@$ﬁﬂ" for c in part) and all(ord(c) < 0x180 or c in "ﬁﬂ" for c in part):
            letters = sum(c.isalpha() for c in part)
            if letters >= 2 and letters * 2 > len(part) and not ("-" in core and re.search(r"\d", core) and part.isupper()):
                out.append((at, at + len(part), part))
        at += len(part)
    return tuple(out)


class _Runs(dict):
    """:func:`run_words` of the runs seen; cleared when full."""

    def __missing__(self, run: str) -> tuple[tuple[int, int, str], ...]:
        if len(self) > 300_000:
            self.clear()
        value = self[run] = run_words(run)
        return value


_RUNS = _Runs()


def text_words(text: str) -> Iterator[tuple[int, int, str]]:
    """Words that can be judged, with their places; words broken across lines are left out."""
    broken = {at for m in BREAK.finditer(text) for at in (m.start(1), m.start(3))}
    for m in RUN.finditer(text):
        start = m.start()
        for a, b, part in _RUNS[m.group()]:
            if not broken or not (start + a in broken or a and start + _RUNS[m.group()][0][0] in broken):
                yield start + a, start + b, part


def _plain(word: str) -> str:
    """Lower case; an I inside a word in small letters stays apart, as it is misread l."""
    return word.lower() if word.isupper() or "I" not in word[1:] else (word[0] + word[1:].replace("I", "|")).lower()


def count_words(pages: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``word, n, m`` over all texts, ``m`` counting equal texts once, and hashed counts of neighbouring words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        once: Counter = Counter()
        near: Counter = Counter()
        pairs = np.zeros(PAIR_CELLS, np.int64)

        def fold() -> None:
            for (before, word), n in near.items():
                pairs[pair_cell(before, word)] += n
            near.clear()

        for batch in batches:
            for text, copies in zip(batch["text"], batch["copies"]):
                found = [_plain(w) for _, _, w in text_words(text)]
                once.update(found)
                if copies == 1:
                    words.update(found)
                    near.update(zip(["", *found], found))
                else:
                    for before, w in zip(["", *found], found):
                        words[w] += copies
                        near[before, w] += copies
            if len(near) > 500_000:
                fold()
            if len(words) > 300_000:
                yield pd.DataFrame({"word": list(words), "cell": -1, "n": list(words.values()), "m": [once[w] for w in words]})
                words.clear()
                once.clear()
        fold()
        at = np.flatnonzero(pairs)
        if words:
            yield pd.DataFrame({"word": list(words), "cell": -1, "n": list(words.values()), "m": [once[w] for w in words]})
        if len(at):
            yield pd.DataFrame({"word": [""] * len(at), "cell": at, "n": pairs[at], "m": 0})

    texts = pages.where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("copies"))
    counted = materialize(texts.mapInPandas(run, "word string, cell int, n bigint, m bigint").groupBy("word", "cell").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "word-counts")
    found = counted.where("cell >= 0").select("cell", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toPandas()  # at most PAIR_CELLS rows
    pairs = np.zeros(PAIR_CELLS, np.int32)
    pairs[found["cell"]] = found["n"]
    pairs = np.maximum(pairs - int(pairs.mean()), 0)  # what other pairs of a cell add on average
    return counted.where("cell < 0").select("word", "n", "m"), pairs


def pair_cell(before: str, word: str) -> int:
    return zlib.crc32(f"{before} {word}".encode("utf-8", "surrogatepass")) % PAIR_CELLS


def corrections(words: DataFrame) -> DataFrame:
    """``read, printed, score, bare``: misread words and what may be printed there, best first by ``score``; ``bare`` ones need the support of their neighbours.

    Of a reading the texts that differ count (``m``), so copies of a noisy page do not vouch for it; a word that is printed must not stand in fewer of them.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(w, n, m, d) for w, n, m in zip(batch["word"], batch["n"], batch["m"]) if len(w) >= 3 for d in deletes(fold(w))]
            yield pd.DataFrame(out, columns=["word", "n", "m", "d"])

    index = materialize(words.mapInPandas(keys, "word string, n bigint, m bigint, d string"), "delete-index")
    sound = index.where(f"n >= {FREQUENT}").where(~F.col("word").rlike(r"[0-9|!@$ﬁﬂ]")).select(F.col("word").alias("printed"), F.col("n").alias("n_true"), F.col("m").alias("m_true"), "d")
    met = index.select(F.col("word").alias("read"), F.col("m").alias("n_read"), "d").join(sound, "d").where(f"read <> printed AND m_true >= n_read AND n_true >= 3 * n_read AND n_read <= 1 + greatest({SHARE} * n_true, IF(read RLIKE '[0-9|!@$ﬁﬂ]', 0.2 * n_true, 0))").select("read", "printed", "n_read", "n_true").distinct()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for read, true, n, m in batch.itertuples(index=False):
                d = distance(true, read)
                if d <= min(1.6, 0.4 * max(1, len(true) // (3 if read.isalpha() else 2))) + 1e-9 and (len(true) >= 4 or not read.isalpha()):
                    out.append((read, true, math.log(m) - 5.0 * d - math.log(n), False))
                elif m >= PLAIN_RATIO * n and plain_substitution(true, read):
                    out.append((read, true, math.log(m) - 8.0 - math.log(n), True))
            yield pd.DataFrame(out, columns=["read", "printed", "score", "bare"])

    return met.mapInPandas(weigh, "read string, printed string, score double, bare boolean").where("score > -4")


def plain_substitution(true: str, read: str) -> bool:
    """Whether one letter inside a long word was read as another; letters that a wrong decoding gives do not count."""
    if len(true) != len(read) or len(true) < PLAIN_LETTERS:
        return False
    other = [i for i, (a, b) in enumerate(zip(true, read)) if a != b]
    return len(other) == 1 and 0 < other[0] < len(true) - 2 and read[other[0]].isascii() and read[other[0]].isalpha() and true[other[0]].isascii()


def header_key(line: str) -> str:
    """A page-edge line without the page's number, folded so that misread copies agree."""
    return re.sub(r"[\W_]+", " ", fold(HEAD_NUMBER.sub(" ", line.strip()).lower())).strip()


def roman(text: str) -> int:
    values, total, last = {"i": 1, "v": 5, "x": 10, "l": 50}, 0, 0
    for c in reversed(text.lower()):
        v = values.get(c, 0)
        total += -v if v < last else v
        last = max(last, v)
    return total


def is_number(text: str, page: int | None) -> bool:
    """Whether ``text`` may be the number of ``page`` (figures that may be misread, or Roman)."""
    if page is None:
        return True
    plain = text.translate(str.maketrans("lIO|!oS", "1101105"))
    if plain.isdigit() and int(plain) == page:
        return True
    return bool(re.fullmatch(r"[ivxlIVXL]+", text)) and roman(text) == page


def page_number_line(line: str, page: int | None) -> bool:
    """Whether a line holds nothing but the page's number, with or without the word for page or the number of pages."""
    s = line.strip()
    m = PAGE_LINE.match(s)
    if not m or re.match(r"^\d+[.,]$|^[-•*] .*[^-]$|^[ivxl]+[.,]$", s, re.I):
        return False
    worded = re.search(rf"{PAGE_WORDS}|/| of | von | sur | de ", s, re.I) is not None and re.search(r"\d|[lIO|]", s) is not None
    if worded and is_number(m.group(1), page):
        return True
    return is_number(m.group(1), page) and (page is not None or not re.search(r"\d{3,}", s))


def edge_lines(text: str) -> list[tuple[int, str]]:
    """The first and last two lines of a page that are not blank, with their numbers."""
    full = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
    return full if len(full) <= 4 else full[:2] + full[-2:]


def numbered_head(line: str, page: int | None) -> bool:
    m = HEAD_NUMBER.search(line)
    return bool(m) and len(line.strip()) < 110 and line.count("|") <= 1 and is_number(m.group(1) or m.group(2), page)


def plausible_head(line: str) -> bool:
    s = line.strip()
    return 3 < len(s) < 110 and not s.startswith(("- ", "[Sheet", "#", "•")) and not re.search(r"[.!?:;,]$", s) and s.count("|") <= 1


def formed_head(lines: list[str], at: int) -> bool:
    """Whether a page-edge line has the form of a running header: columns, a document code, capitals; and does not run on."""
    s = lines[at].strip()
    if not plausible_head(s):
        return False
    capitals = sum(c.isupper() for c in s) > 6 * sum(c.islower() for c in s) and len(re.findall(r"[^\W\d_]{3,}", s)) >= 3
    if not (capitals or HEAD_FORM.match(HEAD_NUMBER.sub("", s))):
        return False
    after = next((x.strip() for x in lines[at + 1 :] if x.strip()), "")
    before = next((x.strip() for x in reversed(lines[:at]) if x.strip()), "")
    return (not before or bool(re.search(r"[.!?”»\"]$", before)) or len(before) < 14 or lines[at - 1].strip() == "" or PAGE_LINE.match(before) is not None or before.startswith("- ")) and (not after or not after[0].islower())


def page_traces(text: str, page: int | None, sheet: bool, headers: set[str], lexicon: dict[str, int]) -> tuple[list[re.Match], list[int]]:
    """The broken words of a page, and the numbers of its header and page-number lines."""
    lines = text.split("\n")
    drop: list[int] = []
    if not sheet:
        edges = {i for i, _ in edge_lines(text)}
        for i, line in enumerate(lines):
            if not line.strip():
                continue
            if page_number_line(line, page):
                drop.append(i)
            elif i in edges and plausible_head(line) and (numbered_head(line, page) or header_key(line) in headers or formed_head(lines, i)):
                drop.append(i)
    broken = [m for m in BREAK.finditer(text) if breaks(m, lexicon)]
    return broken, drop


def breaks(m: re.Match, lexicon: dict[str, int]) -> bool:
    """Whether a line-end hyphen breaks a word, rather than belongs to the wording."""
    a, sign, b = m.group(1), m.group(2), m.group(3)
    if sign in "­¬":
        return True
    whole, joined = lexicon.get((a + b).lower(), 0), lexicon.get(f"{a}-{b}".lower(), 0)
    if whole or joined:
        return whole >= joined
    if b.lower() in SUSPENDED and a[-1:].islower():
        return False
    if sign == "‐":
        return True
    if a[:1].isupper() and b[:1].isupper():
        return False
    return not (lexicon.get(a.lower(), 0) >= 20 and lexicon.get(b.lower(), 0) >= 20)


def join_hyphens(text: str, breaks_here: list[re.Match]) -> str:
    for m in reversed(breaks_here):
        text = text[: m.start()] + m.group(1) + m.group(3) + text[m.end() :]
    return text


def paragraphs(text: str) -> str:
    """Wrapped lines joined into paragraphs; lists, tables and headings keep their lines."""
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n\s*", text):
        lines = [x.strip() for x in block.split("\n") if x.strip()]
        made: list[str] = []
        for line in lines:
            keeps = line.startswith(("- ", "• ", "[Sheet", "#")) or "|" in line
            if made and not keeps and not made[-1].startswith(("[Sheet", "#")) and "|" not in made[-1] and (line[0].islower() or len(made[-1]) > 40):
                made[-1] += " " + line
            else:
                made.append(line)
        if made:
            out.append("\n".join(made))
    return "\n\n".join(out)


PAGE = "doc_id bigint, chunk_index int, page int, sheet boolean, text string"


def pages_of(chunks: DataFrame) -> DataFrame:
    """One row per chunk (rows delivered twice count once); a missing page number is taken from the position."""
    rows = chunks.where(F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull()).groupBy("doc_id", "chunk_index").agg(F.max(F.struct(F.col("text").isNotNull().alias("has"), "text", "page_no", "sheet_name")).alias("r"))
    return rows.select("doc_id", "chunk_index", F.coalesce(F.col("r.page_no"), F.col("chunk_index") + 1).cast("int").alias("page"), F.col("r.sheet_name").isNotNull().alias("sheet"), F.col("r.text").alias("text"))


def running_heads(pages: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, headers``: of the lines at a page's edges, those that repeat on other pages of the document and are no headings.

    A heading may stand at an edge of many documents, but mostly once in each; a running header repeats wherever it stands, in
    one document or in a third of all. So a line is a header if the documents of several pages that have it at an edge have it on
    HEAD_PAGES pages on average. Lines are counted and joined per (document, line), so a document may hold any
    share of the pages; a page gets at most its four.
    """

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, c, k) for d, c, t in zip(batch["doc_id"], batch["chunk_index"], batch["text"]) for k in {header_key(x) for _, x in edge_lines(t) if plausible_head(x) and not page_number_line(x, None)} if len(k) > 3]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "key"])

    rows = pages.where("text IS NOT NULL AND NOT sheet").select("doc_id", "chunk_index", "text")
    found = materialize(rows.mapInPandas(edges, "doc_id bigint, chunk_index int, key string"), "edge-lines")
    several = rows.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 2").select("doc_id")
    per = found.groupBy("doc_id", "key").agg(F.count("*").alias("pages")).join(several, "doc_id", "left_semi")
    headings = per.groupBy("key").agg(F.avg("pages").alias("mean")).where(F.col("mean") < HEAD_PAGES).select("key")
    heads = per.where("pages >= 2").join(headings, "key", "left_anti").select("doc_id", "key")
    return found.join(heads, ["doc_id", "key"]).groupBy("doc_id", "chunk_index").agg(F.collect_set("key").alias("headers"))


def bit_table(spark: SparkSession, cells: DataFrame, size: int) -> Broadcast:
    """A broadcast bit for each of ``size`` cells, set for those in the one column of ``cells``."""
    words = cells.toDF("b").groupBy(F.shiftright("b", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, b & 31))").alias("bits")).toPandas()  # at most size / 32 rows
    bits = np.zeros(size // 32, np.uint32)
    bits[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(bits)


def has_bit(bits: np.ndarray, text: str, size: int) -> bool:
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % size
    return bool(int(bits[at >> 5]) >> (at & 31) & 1)


def broken_lexicon(pages: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, lexicon``: as JSON, counts of the words that the line-end hyphens of a page ask about."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = set()
            for d, c, t in zip(batch["doc_id"], batch["chunk_index"], batch["text"]):
                for m in BREAK.finditer(t):
                    a, b = m.group(1).lower(), m.group(3).lower()
                    out |= {(d, c, x) for x in (a, b, a + b, f"{a}-{b}")}
            yield pd.DataFrame(list(out), columns=["doc_id", "chunk_index", "word"])

    asked = pages.where("text IS NOT NULL").where(F.col("text").rlike(r"[-­‐‑¬][ \t]*\n")).select("doc_id", "chunk_index", "text").mapInPandas(run, "doc_id bigint, chunk_index int, word string")
    return asked.join(words, "word").groupBy("doc_id", "chunk_index").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", F.col("n").cast("int").alias("n"))))).alias("lexicon"))


def repair_pages(chunks: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, hyphens, misread, headers, numbers, noisy, repaired`` for every chunk.

    ``noisy`` tells whether the text holds a trace of scanning. A null text stays null and is never noisy; an empty one stays
    empty; rows delivered twice come out once; an empty table gives none. Rows without ``doc_id`` or
    ``chunk_index`` are left out; further columns are not read. Words and lines are counted over all rows and whole texts.
    """
    spark = chunks.sparkSession
    pages = materialize(pages_of(chunks), "pages")
    words, pairs = count_words(pages)
    fixes = materialize(corrections(words), "corrections")
    known = bit_table(spark, fixes.select(F.pmod(F.crc32(F.encode("read", "utf-8")), F.lit(FILTER_BITS)).cast("int")), FILTER_BITS)

    # words of a page that may have a correction are looked up by a join; the filter keeps them few
    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, str] = {}
        for batch in batches:
            out = set()
            for d, c, t in zip(batch["doc_id"], batch["chunk_index"], batch["text"]):
                for _, _, w in text_words(t):
                    if (p := seen.get(w)) is None:
                        if len(seen) > 300_000:
                            seen.clear()
                        p = _plain(w)
                        p = seen[w] = p if len(p) >= 3 and has_bit(known.value, p, FILTER_BITS) else ""
                    if p:
                        out.add((d, c, p))
            yield pd.DataFrame(list(out), columns=["doc_id", "chunk_index", "read"])

    seen = pages.where("text IS NOT NULL").select("doc_id", "chunk_index", "text").mapInPandas(suspects, "doc_id bigint, chunk_index int, read string")
    best = fixes.groupBy("read").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), "printed", "bare"))), lambda x: F.struct(x["printed"].alias("printed"), (-x["cost"]).alias("score"), x["bare"].alias("bare"))).alias("options"))
    page_fixes = seen.join(best, "read").groupBy("doc_id", "chunk_index").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("read", "options")))).alias("options"))
    rows = pages.join(running_heads(pages), ["doc_id", "chunk_index"], "left").join(broken_lexicon(pages, words), ["doc_id", "chunk_index"], "left").join(page_fixes, ["doc_id", "chunk_index"], "left")
    shared = spark.sparkContext.broadcast(pairs)  # PAIR_CELLS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, c, page, sheet, text, headers, lexicon, options in batch.itertuples(index=False):
                out.append((d, c, *repair_page(text, page, sheet, set(headers) if headers is not None else set(), json.loads(lexicon) if lexicon else {}, json.loads(options) if options else {}, shared.value)))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "hyphens", "misread", "headers", "numbers", "noisy", "repaired"])

    ordered = rows.select("doc_id", "chunk_index", "page", "sheet", "text", "headers", "lexicon", "options")
    return ordered.mapInPandas(run, "doc_id bigint, chunk_index int, hyphens int, misread int, headers int, numbers int, noisy boolean, repaired string")


def repair_page(text: str | None, page: int, sheet: bool, headers: set[str], lexicon: dict[str, int], options: dict, pairs: np.ndarray) -> tuple[int, int, int, int, bool, str | None]:
    """Counts of each trace, whether there is any, and the repaired text."""
    if not text:
        return 0, 0, 0, 0, False, text
    broken, drop = page_traces(text, page, sheet, headers, lexicon)
    misread, fixed, last = 0, [], ""
    words = [(a, b, w, _plain(w)) for a, b, w in text_words(text)] if options else []
    for at, (start, end, w, p) in enumerate(words):
        if p in options:
            after = words[at + 1][3] if at + 1 < len(words) else ""
            found = []
            for o in options[p]:
                before = int(pairs[pair_cell(last, o["printed"])])
                if not o.get("bare") or before >= PLAIN_SUPPORT and pairs[pair_cell(o["printed"], after)] >= PLAIN_SUPPORT:
                    found.append((o["printed"], o["score"] + 0.5 * math.log1p(before)))
            if found:
                true = max(found, key=lambda x: x[1])[0]
                misread += 1
                fixed.append((start, end, true.upper() if w.isupper() and len(w) > 1 else true.capitalize() if w[:1].isupper() else true))
                p = true
        last = p
    lines = text.split("\n")
    numbers = sum(page_number_line(lines[i], page) for i in drop)
    # repairs from the end, so that offsets hold; then lines, then hyphens
    for start, end, true in reversed(fixed):
        text = text[:start] + true + text[end:]
    gone = set(drop)
    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    text = join_hyphens(text, [m for m in BREAK.finditer(text) if breaks(m, lexicon)])
    return len(broken), misread, len(drop) - numbers, numbers, bool(broken or misread or drop), paragraphs(text)
