"""Texts cut off by field limits or in transfer, and how often each source cuts.

Three kinds of evidence are combined for every value:

* lengths: per source a right-censored log-normal distribution is fitted by maximum likelihood; a
  value whose length is a candidate limit gets the posterior that it was censored there;
* the ending: whether the text closes a sentence, ends in a list item, carries a sign of omission, ...;
* the last token: how often it, its last letters or its shape end a sentence or list item inside
  the corpus, counted over all rows in hashed tables of fixed size.

The weights of the endings and the rate of cuts away from any limit are found by expectation
maximisation over the counts of (source, length, ending).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from leafstack.session import materialize

#: Size of each of the hashed tables of last tokens.
BUCKETS = 1 << 19
#: Lengths above this are counted in classes, each BIN times the one before, so that histograms stay bounded; lengths that
#: stand out among those around them, or are known limits, are counted on their own there too.
EXACT_LENGTHS, BIN = 5_000, 1.01
#: Distinct sources, known limits and lengths that stand out above EXACT_LENGTHS are few; more are refused.
MOST_SOURCES, MOST_LIMITS, MOST_SPIKES = 5_000, 10_000, 100_000
#: A length stands out with at least this many values and this many standard deviations above the lengths around it; above EXACT_LENGTHS,
#: where the lengths that may do so by chance are many more, with one deviation more.
LEAST_SPIKE, SPIKE_DEVIATIONS, LONG_DEVIATIONS = 6, 5, 6

ENDINGS = ("full", "full_odd", "reference", "item", "item_rare", "item_never", "sign", "open", "blank")
#: First log odds of a cut given each ending; EM starts from them and keeps them as prior counts.
FIRST_ODDS = {"full": -6.0, "full_odd": -2.0, "reference": -6.0, "item": -4.0, "item_rare": -0.5, "item_never": 5.0, "sign": 7.0, "open": 6.0, "blank": -20.0}

TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]]*$")
SIGN = re.compile(r"(?:…|\.\.\.|\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|\[truncated\]|\[cut\])$", re.I)
REFERENCE = re.compile(r"(?:\[[^\[\]\n]{1,80}\]|\([^()\n]{1,80}\))$")
ITEM = re.compile(r"^\s*(?:[-•*–]|#{1,6}|\d{1,3}[.)]|\|)\s")
SENTENCE_END = re.compile(r"([^\s.!?]+)[.!?][\"'”’»)\]]*(?=\s+[\"'“„«(\[]?[^\W\d_a-zà-ÿ]|\s*$)")
WORD = re.compile(r"[^\W\d_]{3,}")
TOKEN = re.compile(r"[^\s,;:()\[\]\"“”„«»]+")


def _shape(token: str) -> str:
    out = re.sub(r"\d", "0", re.sub(r"[^\W\d_]+", "a", token))
    return out[:12]


def token_keys(token: str, kind: str) -> tuple[int, int, int]:
    """Buckets of a token, of its last letters and of its shape, for list items or sentences."""
    low = token.lower()
    tail = low[-4:] if low[-1:].isalpha() else ""
    return tuple(zlib.crc32(f"{kind}|{i}|{x}".encode("utf-8", "surrogatepass")) % BUCKETS for i, x in enumerate((low, tail or _shape(low), _shape(low))))


def tail_keys(word: str) -> Iterator[tuple[int, bool]]:
    """Buckets of the letter groups of ``word`` (three and four letters), and whether each ends it."""
    for size in (3, 4):
        for at in range(len(word) - size + 1):
            yield _tail(word[at : at + size]), at + size == len(word)


def _tail(letters: str) -> int:
    return zlib.crc32(f"tail|{letters}".encode("utf-8", "surrogatepass")) % BUCKETS


def word_end(token: str, final: np.ndarray, inner: np.ndarray) -> float:
    """How often the last letters of ``token`` end a word where they occur, over the corpus."""
    word = re.search(r"[^\W\d_]*$", token.lower()).group()
    if len(word) < 3:
        return 1.0
    share = 0.5
    for size, weight in ((3, 0.2), (4, 0.5)):
        if len(word) >= size:
            k = _tail(word[-size:])
            share = (final[k] + weight * share) / (final[k] + inner[k] + weight)
    return float(share)


def _lines(text: str) -> list[str]:
    return [line for line in text.rstrip().split("\n") if line.strip()]


def token_stats(text: str, final: Counter, inner: Counter) -> None:
    """Adds, for all of ``text`` but its last line or sentence, which (kind, token) end and which do not."""
    lines = _lines(text)
    for n, line in enumerate(lines):
        last_line = n == len(lines) - 1
        if ITEM.match(line):
            tokens = [t for x in TOKEN.findall(line) if (t := x.rstrip(".!?…"))]
            inner.update(("item", t) for t in tokens[:-1])
            if tokens and not last_line:
                final["item", tokens[-1]] += 1
        else:
            ends = [m for m in SENTENCE_END.finditer(line)]
            at = {m.start(1): m for m in ends}
            stop = len(line) if not last_line else (ends[-2].end() if len(ends) > 1 else 0) if TERMINAL.search(line.rstrip()) else (ends[-1].end() if ends else 0)
            for m in TOKEN.finditer(line, 0, stop):
                token = m.group().rstrip(".!?…")
                if token:
                    box = final if at and any(s in at for s in range(m.start(), m.end())) else inner
                    box["sentence", token] += 1


def ending(text: str | None, final: np.ndarray, inner: np.ndarray) -> str:
    """The ending of ``text``, one of :data:`ENDINGS`."""
    bare = (text or "").rstrip()
    if not bare:
        return "blank"
    if SIGN.search(bare):
        return "sign"
    line = bare.split("\n")[-1]
    if bare.count("[", len(bare) - len(line)) > bare.count("]", len(bare) - len(line)):
        return "open"
    if REFERENCE.search(bare):
        before = REFERENCE.sub("", bare).rstrip()
        if not before or TERMINAL.search(before) or ITEM.match(before.split("\n")[-1]):
            return "reference"
    kind = "item" if ITEM.match(line) and not (TERMINAL.search(line) and len(line) > 60) else "sentence"
    if kind == "sentence" and not TERMINAL.search(bare):
        return "open"
    tokens = [t.rstrip(".!?…") for t in TOKEN.findall(line)]
    token = next((t for t in reversed(tokens) if t), "")
    if kind == "item" and re.search(r"[,;:(\[“„«–-]$", line):
        return "item_never"
    share = end_share(token, kind, final, inner)
    whole = word_end(token, final, inner)
    if kind == "sentence":
        digits = any(c.isdigit() for c in token)
        return "full_odd" if whole < 0.02 or digits and share < 0.01 else "full"
    if whole < 0.02:
        return "item_never"
    return "item" if share >= 0.2 else "item_rare" if share >= 0.004 or whole > 0.5 else "item_never"


def end_share(token: str, kind: str, final: np.ndarray, inner: np.ndarray) -> float:
    """Share of a token's uses that end an item or sentence, backed off to its last letters and shape."""
    if not token:
        return 0.0
    share = 0.1
    for k, weight in zip(reversed(token_keys(token, kind)), (1.0, 1.0, 2.0)):
        share = (final[k] + weight * share) / (final[k] + inner[k] + weight)
    return float(share)


def _bin(length: Column) -> Column:
    """Number of the class of a length above EXACT_LENGTHS."""
    return F.floor(F.log(length / EXACT_LENGTHS) / math.log(BIN)).cast("int")


def bin_edge(number: int) -> float:
    return EXACT_LENGTHS * BIN**number


def exact_lengths(counts: dict[int, int], limits: set[int]) -> list[tuple[float, int, float, bool]]:
    """``length, values, values at a length around it, candidate`` of lengths counted one by one.

    A length is a candidate if it is one of ``limits`` or stands out from the 30 lengths around it.
    """
    lengths = np.array(sorted(x for x in counts if x > 0), np.int64)
    if not len(lengths):
        return []
    n = np.array([counts[x] for x in lengths.tolist()], float)
    whole = np.append(0, np.cumsum(n))
    near = (whole[np.searchsorted(lengths, lengths + 15, side="right")] - whole[np.searchsorted(lengths, lengths - 15)] - n) / 30
    return [(x, c, m, x in limits or (c >= LEAST_SPIKE and c > m + SPIKE_DEVIATIONS * math.sqrt(m + 1))) for x, c, m in zip(lengths.tolist(), n.tolist(), near.tolist())]


def fit_lengths(cells: list[tuple[float, int, float, bool]], rounds: int = 30) -> tuple[float, float, dict[int, float]]:
    """Log-normal mean and deviation under right censoring, and per candidate limit the share censored there, from :func:`exact_lengths`."""
    if not cells:
        return 5.0, 1.0, {}
    lengths, n, near, candidate = (np.array(x) for x in zip(*cells))
    n, candidate = n.astype(float), candidate.astype(bool)
    logs = np.log(lengths)
    free = n.copy()
    free[candidate] = np.minimum(n, near)[candidate]
    total = max(free.sum(), 1.0)
    mu = float((free * logs).sum() / total)
    sd = max(0.15, math.sqrt(float((free * (logs - mu) ** 2).sum() / total)))
    share = np.where(candidate, 0.5, 0.0)
    for _ in range(rounds):
        z = (logs - mu) / sd
        density = np.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi)) / lengths
        expected = n.sum() * density
        tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        share = np.where(candidate, np.clip(1 - np.maximum(expected, near) / n, 0, 1), 0.0)
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-12)
        first = mu + sd * np.minimum(hazard, z + 5)
        second = sd * sd * np.maximum(0.0, 1 + z * hazard - hazard * hazard)
        weight_c, weight_f = n * share, n * (1 - share)
        total = n.sum()
        new = float((weight_f * logs + weight_c * first).sum() / total)
        var = float((weight_f * (logs - new) ** 2 + weight_c * ((first - new) ** 2 + second)).sum() / total)
        if abs(new - mu) < 1e-6:
            break
        mu, sd = new, max(0.15, math.sqrt(var))
    return mu, sd, {int(x): float(s) for x, s, c in zip(lengths, share, candidate) if c}


def fit_cuts(table: list[tuple[str, int, str, int]], limits: set[int], near: dict[tuple[str, int], float] | None = None, rounds: int = 25) -> tuple[dict[str, float], dict[str, float], dict[tuple[str, int], float], float]:
    """Per source the rate of cuts away from limits, per ending its log odds, per (source, limit) the share censored.

    ``table`` counts (source, cell, ending); a cell is a length, or minus one minus the number of a class of lengths. ``near`` holds, for
    each candidate above EXACT_LENGTHS, the values at a length around it.
    """
    by_source: dict[str, Counter] = {}
    cells: Counter = Counter()
    for source, cell, end, n in table:
        if end != "blank":
            by_source.setdefault(source, Counter())[cell] += n
    at_limit = {}
    for s, c in by_source.items():
        seen = exact_lengths({x: n for x, n in c.items() if 0 < x <= EXACT_LENGTHS}, limits)
        seen += [(x, n, (near or {}).get((s, x), 0.0), True) for x, n in c.items() if x > EXACT_LENGTHS]
        seen += [((bin_edge(-1 - x) + bin_edge(-x)) / 2, n, 0.0, False) for x, n in c.items() if x < 0]
        at_limit |= {(s, x): p for x, p in fit_lengths(seen)[2].items()}
    for source, cell, end, n in table:
        if end != "blank":
            cells[source, cell if (source, cell) in at_limit else 0, end] += n
    whole = sum(cells.values()) or 1
    rate = {s: 0.02 for s in by_source}
    odds = dict(FIRST_ODDS)
    prior = 20.0
    for _ in range(rounds):
        cut, kept, source_cut, source_all = Counter(), Counter(), Counter(), Counter()
        for (s, x, e), n in cells.items():
            p = posterior(at_limit.get((s, x)), rate[s], odds[e])
            cut[e] += n * p
            kept[e] += n * (1 - p)
            if not x:
                source_cut[s] += n * p
                source_all[s] += n
        all_cut, all_kept = sum(cut.values()) + 1e-9, sum(kept.values()) + 1e-9
        for e in odds:
            first = 1 / (1 + math.exp(-FIRST_ODDS[e]))
            odds[e] = math.log((cut[e] + prior * first * 0.2) / (all_cut + prior)) - math.log((kept[e] + prior * (1 - first) * 0.2) / (all_kept + prior))
            odds[e] = min(max(odds[e], FIRST_ODDS[e] - 2), FIRST_ODDS[e] + 2)
        pooled = (sum(source_cut.values()) + 1) / (sum(source_all.values()) + 50)
        rate = {s: (source_cut[s] + 50 * pooled) / (source_all[s] + 50) for s in rate}
    return rate, odds, at_limit, whole


def posterior(censored: float | None, rate: float, odds: float) -> float:
    p = min(max(rate if censored is None else max(censored, rate), 1e-4), 0.98)
    return 1 / (1 + math.exp(-(math.log(p / (1 - p)) + odds)))


def _add_tails(words: Counter, final: Counter, inner: Counter) -> None:
    for word, n in words.items():
        for k, ends in tail_keys(word):
            (final if ends else inner)[k] += n
    words.clear()


def end_tables(values: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of ending and inner tokens over all rows of the one text column of ``values``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        final, inner, words, ends, others = Counter(), Counter(), Counter(), Counter(), Counter()

        def fold() -> None:
            for seen, box in ((ends, final), (others, inner)):
                for (kind, token), n in seen.items():
                    for k in token_keys(token, kind):
                        box[k] += n
                seen.clear()
            _add_tails(words, final, inner)

        for batch in batches:
            for text in batch.iloc[:, 0]:
                if text:
                    token_stats(text, ends, others)
                    words.update(WORD.findall(text[: max(text.rstrip().rfind(" "), 0)].lower()))
            if len(words) + len(others) > 300_000:
                fold()
        fold()
        keys = sorted(final.keys() | inner.keys())
        yield pd.DataFrame({"k": keys, "final": [final[k] for k in keys], "inner_": [inner[k] for k in keys]})

    found = values.mapInPandas(count, "k int, final bigint, inner_ bigint").groupBy("k").agg(F.sum("final").alias("final"), F.sum("inner_").alias("inner_")).toPandas()  # at most BUCKETS rows
    final, inner = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    final[found["k"]], inner[found["k"]] = found["final"], found["inner_"]
    return final, inner


def _few(rows: DataFrame, most: int, what: str) -> list:
    """The rows, of which there are at most ``most``."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} {what}")
    return found


def standing_out(judged: DataFrame, limits: set[int]) -> DataFrame:
    """``source, length, near``: of the lengths above EXACT_LENGTHS the known limits and those that stand out from their class and the two beside it."""
    long = judged.where((F.col("length") > EXACT_LENGTHS) & (F.col("ending") != "blank")).groupBy("source", "length").agg(F.count("*").alias("n")).withColumn("bin", _bin(F.col("length")))
    around = long.groupBy("source", "bin").agg(F.sum("n").alias("around")).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).groupBy("source", "bin").agg(F.sum("around").alias("around"))
    wide = F.pow(F.lit(BIN), F.col("bin") + 2) * EXACT_LENGTHS - F.greatest(F.pow(F.lit(BIN), F.col("bin") - 1) * EXACT_LENGTHS, F.lit(float(EXACT_LENGTHS)))
    near = (F.col("around") - F.col("n")) / wide
    found = long.join(around, ["source", "bin"]).withColumn("near", near)
    return found.where(F.col("length").isin(sorted(limits)) | ((F.col("n") >= LEAST_SPIKE) & (F.col("n") > F.col("near") + LONG_DEVIATIONS * F.sqrt(F.col("near") + 1)))).select("source", "length", "near")


def find_truncated(rows: DataFrame, key: str = "result_id", text: str = "summary", source: str = "summary_method", settings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``key, source, length, ending, limit_share, p_cut, truncated`` for every row.

    ``settings`` may name known limits in ``max_summary_length``. Null, empty and blank texts are never
    truncated (ending ``blank``); a null source is a source of its own; repeated rows come out
    repeated; an empty table gives none. Every row and whole texts are used for all counts.
    """
    spark = rows.sparkSession
    limits = {int(r[0]) for r in _few(settings.select("max_summary_length").dropna().distinct(), MOST_LIMITS, "known limits")} if settings is not None else set()
    base = rows.select(F.col(key).alias("k"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    final, inner = end_tables(base.select("text"))
    shared = spark.sparkContext.broadcast((final, inner))  # two arrays of BUCKETS numbers
    kind = rows.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, i = shared.value
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "")
            yield pd.DataFrame({"k": batch["k"], "source": batch["source"], "length": texts.map(len).astype("int32"), "ending": [ending(t, f, i) for t in texts]})

    judged = materialize(base.mapInPandas(judge, f"k {kind}, source string, length int, ending string"), "endings")
    _few(judged.select("source").distinct(), MOST_SOURCES, "sources")
    spikes = _few(standing_out(judged, limits), MOST_SPIKES, "lengths that stand out")
    marked = spark.createDataFrame([(r[0], r[1]) for r in spikes] or [("", -1)], "source string, length int").withColumn("cell", F.col("length"))
    judged = judged.join(F.broadcast(marked), ["source", "length"], "left")  # at most MOST_SPIKES rows
    judged = judged.withColumn("cell", F.when(F.col("length") <= EXACT_LENGTHS, F.col("length")).otherwise(F.coalesce("cell", -1 - _bin(F.col("length")))))
    table = judged.groupBy("source", "cell", "ending").count().collect()  # bounded by sources x (exact lengths, classes, lengths that stand out) x endings
    rate, odds, at_limit, _ = fit_cuts([tuple(r) for r in table], limits, {(r[0], r[1]): r[2] for r in spikes})
    scored = {(s, c, e): (at_limit.get((s, c), 0.0), posterior(at_limit.get((s, c)), rate.get(s, 0.02), odds[e]) if e != "blank" else 0.0) for s, c, e, _ in table}
    if not scored:
        return spark.createDataFrame([], f"{key} {kind}, {source} string, length int, ending string, limit_share double, p_cut double, truncated boolean")
    weights = spark.createDataFrame([(*c, *v) for c, v in scored.items()], "source string, cell int, ending string, limit_share double, p_cut double")
    joined = judged.join(F.broadcast(weights), ["source", "cell", "ending"])
    return joined.select(F.col("k").alias(key), F.nullif(F.col("source"), F.lit("")).alias(source), "length", "ending", "limit_share", "p_cut", (F.col("p_cut") >= least).alias("truncated"))


def truncation_rates(found: DataFrame, key: str = "result_id", source: str = "summary_method") -> DataFrame:
    """Per source: distinct values, values with text, truncated values and their rate."""
    one = found.groupBy(key, source).agg(F.max(F.col("truncated").cast("int")).alias("cut"), F.max((F.col("ending") != "blank").cast("int")).alias("filled"))
    return one.groupBy(source).agg(F.count("*").alias("records"), F.sum("filled").alias("with_text"), F.sum("cut").alias("truncated")).withColumn("rate", F.round(F.col("truncated") / F.greatest("with_text", F.lit(1)), 6))
