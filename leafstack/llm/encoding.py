"""Text decoded with the wrong character encoding: finding the records and restoring them.

Every word with a character beyond ASCII is either as written or the result of an encoding chain (its
true bytes read under another encoding, once or twice). The chain is latent. Expectation
maximisation pools all records: it learns how often each source carries each chain and which
characters follow which kind of character in sound text, so that signs and scripts that are
regular in the corpus stay untouched, while weak single cases are decided by the pool.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leafstack.session import materialize

#: Fixed values: (true encoding, encoding it was read with). ``utf_8>utf_8`` stands for single-byte text read as UTF-8.
SINGLE = (
    ("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("utf_8", "cp437"), ("utf_8", "cp850"), ("utf_8", "cp1251"), ("utf_8", "gbk"), ("utf_8", "cp1250"), ("utf_8", "koi8_r"), ("utf_8", "shift_jis"), ("utf_8", "big5"),
    ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "koi8_r"),
)
CHAINS = ("as written", *(f"{a}>{b}" for a, b in SINGLE), "utf_8>cp1252 twice", "utf_7>ascii", "lossy")
#: Characters of a sound word are at least this likely to need no chain, before any data.
FIRST_RATE = 1e-3
#: Sources are a column of few values; more are refused.
MOST_SOURCES = 5_000

SPACE = re.compile(r"([\x00-\x20]+)")
UTF7 = re.compile(r"\+([A-Za-z0-9+/]{3,})-")
EDGE = "()[]{}.,;:!?\"'|<>/*_=#&-"
#: Typographic signs of ordinary text.
SIGNS = set("’‘“”„‚«»‹›–—…•·°€£¥¢§µ²³¹½¼¾±×÷©®™‰º¿¡­‐‑ √∞≈≤≥≠∑∆Ωπ№′″−→←↑↓✓ª¬¦´¨¸†‡")


@lru_cache(maxsize=8192)
def kind(c: str) -> str:
    """Class of a character."""
    o = ord(c)
    if o < 128:
        return ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else "."
    if o == 0xFFFD:
        return "f"
    if o < 0xA0:
        return "c"
    if c in "¬¦´¨¸†‡ª≠≤≥∆∑Ω" or 0x2500 <= o < 0x25A0:
        return "x"
    if c in "√∞≈∂∫π":
        return "m"
    if c in SIGNS:
        return "p"
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0xFB00 <= o < 0xFB07:
        return "U" if c.isupper() else "L"
    if 0x370 <= o < 0x400:
        return "g"
    if 0x400 <= o < 0x530:
        return "y"
    if 0x2E80 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0xFE30 <= o < 0xFF00:
        return "h"
    return "o"


#: Size of each class, and the likely successions (previous class, class); all others are rare.
SIZES = {"a": 26, "A": 26, "0": 10, ".": 33, "f": 1, "c": 32, "x": 140, "m": 20, "p": 60, "U": 60, "L": 64, "g": 60, "y": 64, "h": 5000, "o": 5000}
LIKELY = {
    "^": {"a": 0.3, "A": 0.3, "U": 0.05, "p": 0.1, "m": 0.01, "L": 0.02, "0": 0.1, ".": 0.1, "g": 0.002, "y": 0.002, "h": 0.002},
    "a": {"a": 0.8, "L": 0.05, "p": 0.02, "0": 0.02, ".": 0.05, "A": 0.002}, "A": {"a": 0.5, "A": 0.3, "U": 0.03, "L": 0.03, "p": 0.02, "0": 0.05, ".": 0.05},
    "L": {"a": 0.7, "L": 0.02, "p": 0.02, ".": 0.05}, "U": {"a": 0.4, "A": 0.3, "U": 0.1, "p": 0.02, ".": 0.05},
    "0": {"0": 0.5, "a": 0.05, "A": 0.05, "p": 0.1, ".": 0.2}, "p": {"a": 0.2, "A": 0.2, "0": 0.2, "p": 0.05, "L": 0.02, "U": 0.05, ".": 0.1}, ".": {"a": 0.2, "A": 0.2, "0": 0.3, "p": 0.1, ".": 0.2, "L": 0.02, "U": 0.02},
    "m": {"0": 0.4, "a": 0.1, "A": 0.1, ".": 0.3}, "g": {"g": 0.7, ".": 0.1}, "y": {"y": 0.8, ".": 0.1}, "h": {"h": 0.5, "a": 0.05, "A": 0.05, ".": 0.1},
}
RARE = {"f": 1e-9, "c": 1e-7, "x": 1e-4, "m": 1e-3, "o": 1e-5}


def first_chance(before: str, c: str) -> float:
    k = kind(c)
    if before in "gy" and k in "aALU" or before in "aALU" and k in "gy":
        return 1e-6 / SIZES[k]  # two alphabets in one word
    return LIKELY.get(before, {}).get(k, RARE.get(k, 5e-4)) / SIZES[k]


def log_chance(word: str, learned: dict[tuple[str, str], float], totals: dict[str, float]) -> float:
    """Log likelihood of a sound word; ``learned`` counts the different words with (class before, character), of which one may be this word."""
    total, before = 0.0, "^"
    for c in word:
        first = first_chance(before, c)
        n = totals.get(before, 0.0)
        total += math.log((max(0.0, learned.get((before, c), 0.0) - 1) + 50 * first) / (n + 50))
        before = kind(c)
    return total


def _to_bytes(word: str, name: str) -> bytes | None:
    try:
        return word.encode(name)
    except UnicodeEncodeError:
        out = bytearray()
        for c in word:
            try:
                out += c.encode(name)
            except UnicodeEncodeError:
                if name in ("cp1252", "cp1251", "cp1250") and ord(c) < 256:
                    out.append(ord(c))
                else:
                    return None
        return bytes(out)


def unread(word: str, true: str, read: str) -> str | None:
    """``word`` with the bytes it has under ``read`` decoded as ``true``; None where that fails or changes nothing."""
    raw = _to_bytes(word, read)
    if raw is None:
        return None
    try:
        out = raw.decode(true)
    except UnicodeDecodeError:
        return None
    return out if out != word else None


def candidates(word: str) -> list[tuple[int, str]]:
    """``(chain number, restored word)`` of every chain that could have given ``word``."""
    out: list[tuple[int, str]] = []
    if word.isascii():
        restored = UTF7.sub(_utf7, word)
        return [(len(CHAINS) - 2, restored)] if restored != word else out
    if "�" in word:
        return [(len(CHAINS) - 1, word)]
    for n, (true, read) in enumerate(SINGLE, 1):
        if (once := unread(word, true, read)) is not None:
            out.append((n, once))
            if true == "utf_8" and read == "cp1252" and not once.isascii() and (twice := unread(once, true, read)) is not None:
                out.append((len(CHAINS) - 3, twice))
    return out


def _utf7(m: re.Match) -> str:
    try:
        out = m.group().encode("ascii").decode("utf-7")
    except UnicodeDecodeError:
        return m.group()
    return out if out and not out.isascii() and all(kind(c) in "LUp" for c in out) else m.group()


@lru_cache(maxsize=200_000)
def candidates_of(word: str) -> tuple[tuple[int, str], ...]:
    return tuple(candidates(word))


def judge(word: str, prior: dict[int, float], learned: dict, totals: dict) -> tuple[list[tuple[int, str, float]], float]:
    """Posterior of each chain for ``word``, and of the word as written."""
    found = candidates_of(word)
    if not found:
        return [], 1.0
    scores = [(0, word, log_chance(word, learned, totals) - (12.0 if word.isascii() else 0.0))]
    for n, restored in found:
        shift = math.log(max(prior.get(n, 0.0), 1e-6))
        if CHAINS[n] == "lossy":
            scores.append((n, word, shift + log_chance(word.replace("�", "é"), learned, totals)))
        else:
            scores.append((n, restored, shift + log_chance(restored, learned, totals)))
    top = max(s for _, _, s in scores)
    whole = sum(math.exp(s - top) for _, _, s in scores)
    post = [(n, r, math.exp(s - top) / whole) for n, r, s in scores]
    return post[1:], post[0][2]


def words_of(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The runs of a text with the white space between them, and ``(number of the run, word)`` of those with something beyond ASCII, without plain marks at their edges."""
    parts = SPACE.split(text)
    found = []
    for i in range(0, len(parts), 2):
        word = parts[i]
        if not word.isascii():
            if bare := word.strip(EDGE):
                found.append((i, bare))
        elif "+" in word and UTF7.search(word):
            found.append((i, word))
    return parts, found


def fit(rows: DataFrame, rounds: int = 4) -> tuple[dict[str, dict[int, float]], dict, dict]:
    """Chain rates per source and character counts, from all texts of ``rows`` (``source, text``)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for source, text in zip(batch["source"], batch["text"]):
                if text and (not text.isascii() or "+" in text):
                    seen.update((source, word) for _, word in words_of(text)[1])
            if len(seen) > 300_000:
                yield _frame(seen)
                seen.clear()
        yield _frame(seen)

    words = materialize(rows.mapInPandas(count, "source string, word string, n bigint").groupBy("source", "word").agg(F.sum("n").alias("n")), "encoding-words")
    if len(words.select("source").distinct().limit(MOST_SOURCES + 1).collect()) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rates: dict[str, dict[int, float]] = {}
    learned: dict[tuple[str, str], float] = {}
    totals: dict[str, float] = {}
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((rates, learned, totals))  # bounded: chains x sources, classes x characters

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rates, learned, totals = shared.value
            chains: Counter = Counter()
            chars: Counter = Counter()
            for batch in batches:
                for source, word, n in batch.itertuples(index=False):
                    post, sound = judge(word, rates.get(source, FLAT), learned, totals)
                    chains["", source, 0] += n * sound
                    for c, _, p in post:
                        chains["", source, c] += n * p
                    if sound > 0.01:
                        before = "^"
                        for c in word:
                            chars[before, c] += sound * math.log2(1 + n)  # a word counts more where it is common, but not by its full number
                            before = kind(c)
            yield pd.DataFrame([("chain", s, str(c), v) for (_, s, c), v in chains.items()] + [("char", b, c, v) for (b, c), v in chars.items()], columns=["what", "a", "b", "v"])

        sums = words.mapInPandas(expect, "what string, a string, b string, v double").groupBy("what", "a", "b").agg(F.sum("v").alias("v")).collect()
        learned = {(r[1], r[2]): r[3] for r in sums if r[0] == "char"}
        totals = {}
        for (b, _), v in learned.items():
            totals[b] = totals.get(b, 0.0) + v
        by: dict[str, Counter] = {}
        for r in sums:
            if r[0] == "chain":
                by.setdefault(r[1], Counter())[int(r[2])] += r[3]
        pooled: Counter = Counter()
        for c in by.values():
            pooled.update(c)
        whole = sum(pooled.values()) or 1.0
        rates = {s: {c: (v.get(c, 0.0) + 200 * max(pooled[c] / whole, 1e-5)) / (sum(v.values()) + 200) for c in range(1, len(CHAINS))} for s, v in by.items()}
    return rates, learned, totals


FLAT = {n: FIRST_RATE for n in range(1, len(CHAINS))}


def _frame(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame([(s, w, n) for (s, w), n in seen.items()], columns=["source", "word", "n"])


def repair(text: str, prior: dict[int, float], learned: dict, totals: dict, least: float = 0.5, seen: dict | None = None) -> tuple[str, int, int, Counter]:
    """Restored text, words restored, words that cannot be restored, and their chains. ``seen`` keeps judgements made under the same ``prior``."""
    seen = {} if seen is None else seen
    parts, words = words_of(text)
    found = []
    for i, w in words:
        judged = seen.get(w)
        if judged is None:
            if len(seen) > 100_000:
                seen.clear()
            judged = seen[w] = judge(w, prior, learned, totals)
        found.append((i, w, *judged))
    tally: Counter = Counter()
    for *_, post, _ in found:
        for c, _, p in post:
            tally[c] += p
    # the record's own chains count for its undecided words
    own = {c: (v + prior.get(c, 0.0)) / (len(found) + 1) for c, v in tally.items() if v > 0.9}
    again: dict[str, tuple] = {}
    restored, lost, chains = 0, 0, Counter()
    for i, w, post, sound in found:
        if own and post and 1e-6 < sound < 1 - 1e-6:
            if w not in again:
                again[w] = judge(w, own, learned, totals)
            post, sound = again[w]
        if 1 - sound < least or not post:
            continue
        c, word, _ = max(post, key=lambda x: x[2])
        chains[CHAINS[c]] += 1
        if CHAINS[c] == "lossy":
            lost += 1
            continue
        at = parts[i].index(w)
        parts[i] = parts[i][:at] + word + parts[i][at + len(w) :]
        restored += 1
    return "".join(parts), restored, lost, chains


def repair_encoding(docs: DataFrame, key: str = "doc_id", text: str = "full_text", source: tuple[str, ...] = ("file_type",), rounds: int = 4) -> DataFrame:
    """``key, garbled, restorable, words_restored, words_lost, chains, restored`` for every record.

    ``garbled`` tells whether the text holds a stretch from a wrong decoding, ``restorable`` whether every
    such word could be restored, ``restored`` the text with them restored (the text itself where
    nothing is garbled, null for a null text). ``source`` names the columns whose values share chain rates; nulls
    count as a value. Repeated rows come out repeated; an empty table gives none. The rates and
    counts are taken over all rows and whole texts.
    """
    label = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in source)) if source else F.lit("")
    rows = docs.select(F.col(key).alias("k"), label.alias("source"), F.col(text).alias("text"))
    model = fit(rows.select("source", "text").where(F.col("text").isNotNull()), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rates, learned, totals = shared.value
        seen: dict[str, dict] = {}
        for batch in batches:
            out = []
            for k, s, t in batch.itertuples(index=False):
                if t is not None and t.isascii() and not UTF7.search(t):
                    out.append((k, False, True, 0, 0, [], t))
                    continue
                if t is None:
                    out.append((k, False, True, 0, 0, [], None))
                    continue
                fixed, done, lost, chains = repair(t, rates.get(s, FLAT), learned, totals, seen=seen.setdefault(s, {}))
                out.append((k, done + lost > 0, lost == 0, done, lost, sorted(chains), fixed))
            yield pd.DataFrame(out, columns=["k", "garbled", "restorable", "words_restored", "words_lost", "chains", "restored"])

    kind_of = docs.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"k {kind_of}, garbled boolean, restorable boolean, words_restored int, words_lost int, chains array<string>, restored string").withColumnRenamed("k", key)
