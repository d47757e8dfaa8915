"""Scores for abusive, hateful or sexually explicit language, by a factorization machine.

Texts are undisguised (look-alike letters, figures for letters, drawn-out, spaced and starred words), cut
into sentences and turned into hashed terms, words cut to their first letters. For each of three kinds a factorization
machine ``w0 + sum w_i + sum_{i<j} <v_i, v_j>`` is trained, so that words that are harmless alone (a group, a verb) count
together. A document scores as its worst sentence.

Training is on the driver, from bags of single words (``toxicity_terms``: pairs of classes among neutral words), at most
``most_labels`` reviewed documents and at most ``background`` unreviewed ones (documented bounds). Reviewers mark
documents, not sentences: in a marked document the sentence that the machine and the terms unknown to sound
documents point to is taken, and the machine trained again. Scoring covers every document and its whole text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from leafstack.llm import toxicity_terms as terms

KINDS = ("abusive", "hateful", "sexual")
BUCKETS = 1 << 20
FACTORS = 6
MOST_LABELS, BACKGROUND = 5_000, 2_000
#: Characters of a training text that the driver reads, as a bound on its memory; a longer one is left out of training (not of scoring).
MOST_CHARS = 200_000
#: Letters of a term that count, so that inflected forms agree.
STEM = 7
#: Bags of each pair of classes and language.
BAGS = 150
#: Passes over the training rows before and after each choice of sentences; weight of a bag or sentence that is not sound.
FIRST_ROUNDS, NEXT_ROUNDS, POSITIVE = 6, 4, 3.0
#: Terms of a sentence are looked at in windows of at most this many, every half window, so that long sentences dilute nothing.
WINDOW = 48

#: Letters of other scripts that look like Latin ones, and figures and signs that stand for letters.
LOOKALIKE = str.maketrans("аеорсхуікјѕһԁӏԛԝвмнткАВЕЗКМНОРСТХУІЈЅαορεικντυχηАΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyikjshdlqwbmhtkABE3KMHOPCTXYIJSaopeikvtuxnABEZHIKMNOPTYX")
FIGURES = str.maketrans("01345789$@!|€£+", "oieastbgsaiielt")
#: A token (group 1) or the end of a sentence.
PLAIN = re.compile(r"\w+|[.!?…;:][\"'”»]?\s|\n| [-–—] ")
TOKEN = re.compile(r"[\w$@€][\w*$@!|€+]*[\w*$@|+]|[^\W_]|[.!?…;:][\"'”»]?\s|\n| [-–—] ")
#: A sign inside a word or before it; a text without any is cut into plain words, which is faster and gives the same tokens.
SIGNED = re.compile(r"[*$@!|€+](?=[\w*$@!|€+])|_|(?<=\w)[*$@|+]")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_·*][^\W\d_]){2,}(?![^\W_])")
SPACED_HINT = re.compile(r"[ .\-_·*][^\W\d_][ .\-_·*][^\W\d_][ .\-_·*]")
RUN = re.compile(r"(.)\1+")
STARRED = re.compile(r"[^\W\d_]+\*{2,}[^\W\d_]*|[^\W\d_]\*+[^\W\d_]+")
MARKS = re.compile(r"[̀-ͯ]")


def undisguised(token: str) -> str:
    """A word without case, accents, look-alikes, figures for letters and drawn-out letters."""
    t = unicodedata.normalize("NFKD", token.translate(LOOKALIKE).casefold())
    t = MARKS.sub("", t)
    if STARRED.fullmatch(t):
        return "***"
    if t.isdigit():
        return "0"
    if not t.isalpha():
        if sum(c.isalpha() for c in t) == 0 or re.search(r"\d\d\d|-", t):
            return "0"
        t = t.translate(FIGURES)
    return RUN.sub(r"\1", t)


def canonical(token: str) -> str:
    """The term of a token: undisguised and cut to its first letters."""
    return undisguised(token)[:STEM]


def words_of(name: str) -> list[str]:
    return [w for text in getattr(terms, name).values() for w in text.split()]


STRONG = frozenset(u for name in terms.STRONG for w in words_of(name) if len(u := undisguised(w)) >= 3)
#: Terms that people star out.
STARRABLE = frozenset(canonical(w) for name in ("INSULT", "CURSE", "SLUR", "SEX_BODY", "SEX_ACT") for w in words_of(name))


class _Terms(dict):
    """Hash buckets of tokens seen, -1 for the end of a sentence; cleared when full."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[token] = -1 if ends(token) else bucket(canonical(token))
        return value


def ends(token: str) -> bool:
    """Whether a match of PLAIN or TOKEN is the end of a sentence."""
    return not any(c.isalnum() or c in "_$@€" for c in token)


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def unspaced(m: re.Match) -> str:
    """``f u c k`` as one word; a longer chain is cut at the strong words in it, if there are any."""
    joined = "".join(c for c in m.group() if c.isalpha())
    plain = undisguised(joined)
    if plain in STRONG:
        return joined
    at, out = 0, []
    while at < len(plain):
        word = next((plain[at:end] for end in range(len(plain), at + 2, -1) if plain[at:end] in STRONG), None)
        if word:
            out.append(word)
        at += len(word) if word else 1
    return " ".join(out) or (joined if len(joined) > 3 else m.group())


def tokens_of(text: str) -> list[str]:
    """Raw tokens of a text, with the ends of its sentences among them."""
    if "*" in text:
        text = STARRED.sub("xx**xx", text)
    if SPACED_HINT.search(text):
        text = SPACED.sub(unspaced, text)
    return (TOKEN if SIGNED.search(text) else PLAIN).findall(text)


def spread(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of many texts at once: values of the terms, the window of each, and the text of each window.

    ``values`` holds the terms of all texts, -1 at the end of a sentence; a text starts at each of ``first``.
    A sentence of more than WINDOW terms gives a window every half of it.
    """
    n = len(values)
    starts = np.zeros(n + 1, bool)
    starts[first[first < n]] = True
    starts[1:][values == -1] = True
    at = np.flatnonzero(starts[:n])
    size = np.diff(np.append(at, n))
    size -= values[at + size - 1] == -1
    half = WINDOW // 2
    count = np.where(size <= WINDOW, 1, -(-(size - half) // half))
    base = np.cumsum(count) - count
    sentence = np.cumsum(starts[:n]) - 1
    place = (np.arange(n) - at[sentence]) // half
    real = values != -1
    one = real & ((place < count[sentence]) | (size[sentence] <= WINDOW))
    two = real & (place >= 1) & (size[sentence] > WINDOW)
    window = np.concatenate([(base[sentence] + np.where(size[sentence] <= WINDOW, 0, place))[one], (base[sentence] + place - 1)[two]])
    text = np.repeat(np.searchsorted(first, at, side="right") - 1, count)
    return np.concatenate([values[one], values[two]]), window, text


def window_sets(text: str, hashed: _Terms) -> list[list[int]]:
    """Distinct buckets of every window of a text, empty windows left out."""
    found = [hashed[t] for t in tokens_of(text)]
    if not found:
        return []
    values, window, _ = spread(np.array(found, np.int64), np.zeros(1, np.int64))
    both = np.unique(window * BUCKETS + values)
    owner, value = np.divmod(both, BUCKETS)
    return [x.tolist() for x in np.split(value, np.flatnonzero(np.diff(owner)) + 1) if len(x)]


@dataclass
class Model:
    """Weights of the active buckets: row ``row[b]`` of ``weights`` (kinds) and ``factors`` (kinds, FACTORS)."""

    bias: np.ndarray
    row: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray


def bags(neutral: list[list[int]], seed: int = 3) -> list[Row]:
    """Training rows from the word classes: words of each pair of classes among neutral terms, and words of single classes or trades as sound ones."""
    rng = np.random.default_rng(seed)
    none = (0.0, 0.0, 0.0)
    hashed = {n: {lang: [bucket(canonical(w)) for w in words.split()] for lang, words in getattr(terms, n).items()} for n in dir(terms) if n.isupper() and isinstance(getattr(terms, n), dict) and n not in ("PAIRS", "TRADES")}
    star = bucket("***")
    starrable = {bucket(t) for t in STARRABLE}

    def fill(least: int, most: int) -> list[int]:
        if not neutral:
            return []
        x = neutral[rng.integers(len(neutral))]
        return rng.choice(x, min(len(x), int(rng.integers(least, most + 1))), replace=False).tolist()

    out = []
    for lang in terms.ADDRESS:
        pick = lambda name: int(rng.choice(hashed[name][lang]))  # noqa: B023, E731
        for number, kind in enumerate(KINDS):
            target = tuple(float(i == number) for i in range(3))
            for classes in terms.PAIRS[kind]:
                for _ in range(BAGS):
                    words = [pick(c) for c in classes]
                    if rng.random() < 0.5:
                        words += [pick("ADDRESS"), pick("ADDRESS")]
                    x = words + fill(0, 8)
                    out.append((x, target, POSITIVE))
                    hidden = [star if b in starrable else b for b in x]
                    if hidden != x and rng.random() < 0.15:
                        out.append((hidden, target, POSITIVE / 2))
        for name in hashed:
            if name not in ("INSULT", "SLUR"):
                out += [([pick(name), *fill(4, 20)], none, 1.0) for _ in range(2 * BAGS)]
        for _ in range(3 * BAGS):
            out.append(([pick("INSULT" if rng.random() < 0.7 else "CURSE"), *(pick("QUOTING") for _ in range(rng.integers(2, 6))), *fill(2, 12)], none, 1.0))
            out.append(([pick("GROUP"), *fill(3, 14), pick("GROUP")], none, 1.0))
            out.append(([pick("ADDRESS"), pick("ADDRESS"), *fill(3, 14)], none, 1.0))
        for trade in terms.TRADES[lang]:
            b = [bucket(canonical(w)) for w in trade.split()]
            out += [([*rng.choice(b, min(len(b), int(rng.integers(2, 7))), replace=False).tolist(), *fill(2, 10)], none, 1.0) for _ in range(3 * BAGS)]
    return [(sorted(set(x)), y, w) for x, y, w in out if x]


Row = tuple[list[int], tuple[float, ...], float]


class Trainer:
    """A machine per kind by AdaGrad on the logistic loss, over the buckets of ``vocabulary``. Without ``pairwise`` its linear part alone."""

    def __init__(self, vocabulary: np.ndarray, rate: float = 0.05, shrink: float = 2e-4, seed: int = 5, pairwise: bool = True):
        self.rng = np.random.default_rng(seed)
        self.used, self.rate, self.shrink, self.pairwise = vocabulary, rate, shrink, pairwise
        n, k = len(vocabulary), len(KINDS)
        self.w = np.zeros((n, k), np.float32)
        self.v = self.rng.normal(0, 0.05, (n, k, FACTORS)).astype(np.float32) * pairwise
        self.bias = np.full(k, -3.0, np.float32)
        self.gw, self.gv, self.gb = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), np.full_like(self.bias, 1e-2)

    def run(self, rows: list[Row], rounds: int) -> Model:
        """Goes on over ``rows`` of (buckets, targets per kind, weight)."""
        sizes = np.array([len(r[0]) for r in rows])
        flat = np.searchsorted(self.used, np.fromiter((b for r in rows for b in r[0]), np.int64, int(sizes.sum())))
        ends = np.cumsum(sizes)
        y = np.array([r[1] for r in rows], np.float32)
        weight = np.array([r[2] for r in rows], np.float32)
        for _ in range(rounds):
            for part in np.array_split(self.rng.permutation(len(rows)), max(1, len(rows) // 256)):
                owner = np.repeat(np.arange(len(part)), sizes[part])
                starts = np.cumsum(sizes[part]) - sizes[part]
                x = flat[np.arange(len(owner)) - starts[owner] + (ends - sizes)[part][owner]]
                self._step(x, owner, starts, y[part], weight[part])
        return Model(self.bias.copy(), {int(b): i for i, b in enumerate(self.used)}, self.w.copy(), self.v.copy())

    def _step(self, x: np.ndarray, owner: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        w, v = self.w, self.v
        z = self.bias + np.add.reduceat(w[x], starts, 0)
        if self.pairwise:
            vx = v[x]
            s = np.add.reduceat(vx, starts, 0)
            z = z + 0.5 * ((s**2).sum(-1) - np.add.reduceat((vx**2).sum(-1), starts, 0))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight[:, None]
        keep = (np.abs(g).max(1) > 2e-3)[owner]
        if not keep.any():
            return
        x, owner = x[keep], owner[keep]
        go = g[owner]
        by = np.argsort(x, kind="stable")
        touched, first = np.unique(x[by], return_index=True)
        dw = np.add.reduceat(go[by], first, 0) + self.shrink * len(y) * w[touched]
        self.gw[touched] += dw**2
        w[touched] -= self.rate * dw / np.sqrt(self.gw[touched])
        if self.pairwise:
            dv = np.add.reduceat((go[:, :, None] * (s[owner] - vx[keep]))[by], first, 0) + self.shrink * len(y) * v[touched]
            self.gv[touched] += dv**2
            v[touched] -= self.rate * dv / np.sqrt(self.gv[touched])
        db = g.sum(0)
        self.gb += db**2
        self.bias -= self.rate * db / np.sqrt(self.gb)


def train(rows: list[Row], rounds: int = 14, **options) -> Model:
    """A machine from ``rows`` alone."""
    return Trainer(np.unique(np.concatenate([np.asarray(r[0], np.int64) for r in rows])), **options).run(rows, rounds)


class _Rows(dict):
    """Row of the model for every token seen, -2 if it has none, -1 for the end of a sentence; cleared when full."""

    def __init__(self, model: Model):
        self.known = model.row

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[token] = -1 if ends(token) else self.known.get(bucket(canonical(token)), -2)
        return value


def score_many(model: Model, lists: list[list[int]]) -> np.ndarray:
    """Scores per kind of bucket lists; buckets never trained count nothing."""
    get = model.row.get
    flat = np.array([get(b, -1) for x in lists for b in x], np.int64)
    return score_rows(model, flat, np.repeat(np.arange(len(lists)), [len(x) for x in lists]), len(lists))


def score_rows(model: Model, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Scores per kind of ``n`` windows; ``rows`` of the model belong to the windows in ``owner``; a term counts once."""
    out = np.tile(1 / (1 + np.exp(-model.bias)), (n, 1)).astype(np.float64)
    keep = rows >= 0
    both = np.sort(owner[keep] * len(model.weights) + rows[keep])
    if not len(both):
        return out
    both = both[np.append(True, both[1:] != both[:-1])]
    owner, rows = np.divmod(both, len(model.weights))
    which, starts = np.unique(owner, return_index=True)
    v = model.factors[rows]
    s = np.add.reduceat(v, starts, 0)
    q = np.add.reduceat((v**2).sum(-1), starts, 0)
    z = model.bias + np.add.reduceat(model.weights[rows], starts, 0) + 0.5 * ((s**2).sum(-1) - q)
    out[which] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score_texts(model: Model, texts: list[str | None], row_of: _Rows | None = None) -> np.ndarray:
    """Scores per kind of each text, the worst of its windows; 0 for a text without a term."""
    row_of = _Rows(model) if row_of is None else row_of
    values: list[int] = []
    first = np.empty(len(texts), np.int64)
    for n, body in enumerate(texts):
        first[n] = len(values)
        if body:
            values += map(row_of.__getitem__, tokens_of(body))
    best = np.zeros((len(texts), 3))
    if values:
        rows, window, text = spread(np.array(values, np.int64), first)
        held = np.bincount(window, minlength=len(text)) > 0
        scores = score_rows(model, rows, window, len(text))
        np.maximum.at(best, text[held], scores[held])
    return best


def fit_rows(background: list[str], reviewed: list[tuple[str, int, int, int]], rounds: int = 3, pairwise: bool = True) -> Model:
    """The machine from the word classes, unreviewed texts and reviewed ones ``(text, abusive, hateful, sexual)``.

    Of unreviewed texts the windows that the machine of the round before calls sound count as such.
    """
    hashed = _Terms()
    none = (0.0, 0.0, 0.0)
    around = sorted({tuple(x) for body in background for x in window_sets(body, hashed)})
    bad = [(lists, marks) for body, *marks in reviewed if any(marks) and (lists := window_sets(body or "", hashed))]
    sound = sorted({tuple(x) for body, *marks in reviewed if not any(marks) for x in window_sets(body or "", hashed)})
    known = Counter(b for x in (*around, *sound) for b in x)
    listed = {bucket(canonical(w)) for name in (*terms.STRONG, "THREAT", "EXPEL") for w in words_of(name)}
    made = bags([list(x) for x in (around or sound) if len(x) > 3 and not listed.intersection(x)])
    clean = [(list(x), none, 1.0) for x in sound]
    whole = np.fromiter({b for x in (*(r[0] for r in made), *around, *sound, *(x for lists, _ in bad for x in lists)) for b in x}, np.int64)
    trainer = Trainer(np.sort(whole), pairwise=pairwise)
    model = trainer.run(made + clean, FIRST_ROUNDS)
    for _ in range(rounds):
        more: list[Row] = []
        for lists, marks in bad:
            scores = score_many(model, lists)
            odd = np.array([sum(known[b] <= 2 for b in x) / (len(x) + 2) for x in lists])
            logit = np.log(np.clip(scores, 1e-6, 1 - 1e-6) / np.clip(1 - scores, 1e-6, 1))
            for i, mark in enumerate(marks):
                if mark:  # the sentences that made the document what it is: the worst, and others like it
                    best = int(np.argmax(logit[:, i] + 8 * odd))
                    more += [(x, tuple(float(j == i) for j in range(3)), POSITIVE) for n, x in enumerate(lists) if n == best or scores[n, i] > 0.7]
        if around:
            kept = score_many(model, around).max(1) < 0.3
            more += [(list(x), none, 0.5) for x, k in zip(around, kept) if k]
        model = trainer.run(made + clean + more, NEXT_ROUNDS)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most_labels: int = MOST_LABELS, background: int = BACKGROUND) -> tuple[list[str], list[tuple[str, int, int, int]]]:
    """Unreviewed texts and reviewed ones with their verdicts, within the bounds."""
    docs = docs.select(key, text).where(F.length(text) <= MOST_CHARS)
    reviewed = labels.dropna(subset=[key]).groupBy(key).agg(*(F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in KINDS))
    # both verdicts in turn, so that neither drives the other out; a verdict with few documents leaves its room to the other
    bad, ranked = F.greatest(*KINDS) > 0, W.partitionBy("bad").orderBy("h")
    held = [reviewed.withColumns({"bad": bad, "h": F.xxhash64(key)}).where(c).orderBy("h").limit(most_labels) for c in ("bad", "NOT bad")]
    reviewed = held[0].unionByName(held[1]).withColumn("nth", F.row_number().over(ranked)).orderBy("nth", F.desc("bad")).limit(most_labels).drop("bad", "h", "nth")
    marked = docs.join(F.broadcast(reviewed), key).select(text, *KINDS).dropDuplicates().limit(2 * most_labels).collect()
    some = docs.select(key, F.xxhash64(F.lit("background"), key).alias("h")).orderBy("h").limit(background)
    bodies = docs.join(F.broadcast(some), key).select(text).limit(2 * background).collect() if background else []
    return sorted(r[0] for r in bodies), sorted(tuple(r) for r in marked)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **bounds: int) -> Model:
    """The machine from the word classes, reviewed documents and a background sample."""
    return fit_rows(*training_rows(docs, labels, key, text, **bounds))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", least: float = 0.5, **bounds: int) -> DataFrame:
    """``key, source, abusive, hateful, sexual, score, flagged`` for every document.

    Null and empty texts score 0. Repeated rows come out repeated; an empty table gives none; labels of
    unknown documents are ignored, and without labels the word classes alone decide. ``score`` is the largest of the three.
    """
    model = fit(docs, labels, key, text, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training bounds
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        row_of = _Rows(model)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                best = np.round(score_texts(model, part["t"].tolist(), row_of), 6)
                yield pd.DataFrame({"k": part["k"].to_numpy(), "s": part["s"].to_numpy(), **{c: best[:, i] for i, c in enumerate(KINDS)}})

    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"))
    out = rows.mapInPandas(run, f"k {kind}, s string, abusive double, hateful double, sexual double")
    out = out.withColumn("score", F.greatest(*KINDS)).withColumn("flagged", F.col("score") >= least)
    return out.withColumnRenamed("k", key).withColumnRenamed("s", source)


def rates(scored: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per source: documents, flagged documents, their rate, and how many of each kind."""
    return scored.groupBy(source).agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), *(F.count_if(F.col(c) >= 0.5).alias(f"{c}_documents") for c in KINDS)).withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))
