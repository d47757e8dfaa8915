"""Checking new batches for duplicates against everything accepted before, without going through it again.

The history is kept as a written index, every table of it in parts by hash:

* ``classes``: rows of equal wording are one class; its representative is the row that brought it first;
* ``members``: the rows of each representative;
* ``texts``: the words of the representatives, as 32-bit hashes;
* ``keys``: minwise band keys of the representatives, each with a sketch of the words;
* ``bare``: rows without text, by file hash.

The number of parts follows the size of the first load, so that a part stays of one size. A batch reads only the parts
that its classes, keys and candidates fall into; candidates whose sketches agree are verified by the longest common
subsequence of words, and the batch's own rows are appended. Shingles are word pairs: the bound here is on words in
order (80 of 100), which may leave few long shingles intact. All pairs of a text count, however many
documents they stand in, so that the links of a text with thousands of variants are found as well.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafstack.session import discard, materialize, new_folder

#: Bands of a text, and pair hashes in a band. Texts at the bound share 0.43 of their pairs or more: 0.98 of them share a band, at 0.5 0.998.
BANDS, ROWS = 48, 3
#: Texts of at most this many pairs, where one changed word weighs more, also get bands of two.
SHORT, SHORT_BANDS = 32, 28
#: Minwise hashes of the words, of which two bits each are kept beside the keys, and the standard deviations by which their agreement may fall
#: short of what texts at the bound have. Texts of one length share two thirds of their words, so three in four hashes agree. With one bit
#: each, one in seven pairs that share half of their words in a form passed, and their words were sent about.
SKETCH, DEVIATIONS = 128, 3.5
#: Rows of the first load to a part of the index.
PART_ROWS = 20_000
#: Bits of the filter that a batch's values set; rows of the index that meet none are dropped before the shuffle.
FILTER_BITS = 1 << 24
#: From this many parts on, a batch first asks which it meets; fewer are all met.
MANY_PARTS = 16
#: Rows of one key up to which it is joined in one piece; larger keys are salted.
HOT_KEY = 1_000
SHARE = 0.8

WORD = re.compile(r"[^\W_]+")
MARKS = re.compile(r"[̀-ͯ]")


def normal_words(text: str | None) -> list[str]:
    """Words of ``text`` without case, accents and punctuation."""
    if not text:
        return []
    t = text.casefold()
    if not t.isascii():
        t = MARKS.sub("", unicodedata.normalize("NFKD", t))
    return WORD.findall(t)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the distinct pairs of neighbouring words; of a single word, of the word."""
    w = words.astype(np.uint64)
    x = w[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (w[1:] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) if len(w) > 1 else w * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return np.unique(x * np.uint64(0xBF58476D1CE4E5B9))


_SEEDS = np.random.default_rng(17).integers(1, 2**63, BANDS * ROWS + SHORT_BANDS * 2, dtype=np.uint64) | np.uint64(1)
_SKETCH_SEEDS = np.random.default_rng(18).integers(1, 2**63, SKETCH, dtype=np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least value of ``hashes`` under each of the hash functions of ``seeds``."""
    low = np.empty(len(seeds), np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * seeds[None, :]
        part ^= part >> np.uint64(32)
        m = part.min(0)
        low = m if at == 0 else np.minimum(low, m)
    return low


def band_keys(words: np.ndarray) -> list[int]:
    """Minwise band keys of a text over all its word pairs."""
    pairs = pair_hashes(words)
    short = len(pairs) <= SHORT
    low = minima(pairs, _SEEDS if short else _SEEDS[: BANDS * ROWS])
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(31)) ^ part) * np.uint64(0x9E3779B97F4A7C15)
    if short:
        two = low[BANDS * ROWS :].reshape(SHORT_BANDS, 2)
        key = np.append(key, two[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (two[:, 1] + np.arange(SHORT_BANDS, dtype=np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (key ^ (key >> np.uint64(31))).astype(np.int64).tolist()


def sketch(words: np.ndarray) -> tuple[int, int, int, int]:
    """Two bits of each of SKETCH hashes of a text, the first bits before the second ones; a word that stands twice counts as two."""
    w = np.sort(words).astype(np.uint64)
    nth = np.arange(len(w)) - np.searchsorted(w, w)
    x = (w + (nth.astype(np.uint64) << np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    low = minima(x * np.uint64(0x9E3779B97F4A7C15), _SKETCH_SEEDS)
    bits = np.packbits((np.concatenate([low >> np.uint64(17), low >> np.uint64(18)]) & np.uint64(1)).astype(np.uint8))
    return tuple(bits.view(np.int64).tolist())


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    head = 0
    stop = min(len(a), len(b))
    same = a[:stop] != b[:stop]
    head = int(np.argmax(same)) if same.any() else stop
    a, b = a[head:], b[head:]
    if not len(a) or not len(b):
        return head
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return head + (~row & full).bit_count()


def same_document(a: np.ndarray, b: np.ndarray, share: float = SHARE) -> bool:
    """At least ``share`` of the words of the longer text stand in the other in the same order."""
    need = share * max(len(a), len(b))
    if min(len(a), len(b)) < need:
        return False
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if np.minimum(nx[i], ny[j]).sum() < need:
        return False
    return common_subsequence(a, b) >= need - 1e-9


SKETCHED = ["s1", "s2", "s3", "s4"]
PREPARED = "id bigint, class binary, words binary, hash string, keys array<bigint>, s1 bigint, s2 bigint, s3 bigint, s4 bigint"


def prepare(rows: DataFrame, key: str = "id", text: str = "content_text", file_hash: str = "file_hash") -> DataFrame:
    """``id, class, words, hash, keys`` and the sketch (``s1`` to ``s4``) of every row; rows without a word have a null class, nulls in ``key`` are left out.

    ``class`` is a 96-bit hash of the wording.
    """
    source = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.lower(F.trim(F.col(file_hash))).alias("hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            out = []
            for i, t, h in batch.itertuples(index=False):
                words = normal_words(t)
                if not words:
                    out.append((i, None, None, h, None, *[None] * len(SKETCHED)))
                    continue
                of = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=12).digest()
                numbers = np.array([hashes[w] for w in words], np.uint32)
                if of not in seen:
                    if len(seen) > 2_000:
                        seen.clear()
                    seen[of] = band_keys(numbers), *sketch(numbers)
                out.append((i, of, numbers.tobytes(), h, *seen[of]))
            yield pd.DataFrame(out, columns=["id", "class", "words", "hash", "keys", *SKETCHED]).astype(dict.fromkeys(SKETCHED, "Int64"))

    return source.mapInPandas(run, PREPARED)


def salted_join(few: DataFrame, many: DataFrame, on: str, written: list[str], hot: int = HOT_KEY) -> DataFrame:
    """Equi-join on ``on``; keys with more than ``hot`` rows in ``many`` are cut into pieces there, and ``few`` meets every piece. Both are read twice."""
    parts = many.groupBy(on).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(on, F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    parts = materialize(parts, "hot-keys", written)
    if parts.isEmpty():
        return few.join(many, on)
    left = few.join(parts, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    right = many.join(parts, on, "left").withColumn("salt", F.pmod(F.xxhash64(*(c for c in many.columns if c != on)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return left.join(right, [on, "salt"]).drop("salt")


def looked_up(rows: DataFrame, by: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: whether ``by`` sets a bit that a value of ``wanted`` sets too, in a filter of fixed size. No value of ``wanted`` is missed."""
    cell, word = F.pmod(F.xxhash64(by), F.lit(FILTER_BITS)).cast("int"), F.shiftright("c", 6).alias("w")
    bits = wanted.select(cell.alias("c")).groupBy(word).agg(F.expr("bit_or(shiftleft(1L, c & 63))").alias("bits"))
    found = rows.select("*", cell.alias("c")).select("*", word).join(F.broadcast(bits), "w", "left")  # at most FILTER_BITS / 64 rows
    return found.select(*rows.columns, F.coalesce(F.expr("bit_get(bits, c & 63) = 1"), F.lit(False)).alias("hit"))


TABLES = {"classes": "class binary, rep bigint", "members": "rep bigint, id bigint, seed boolean", "texts": "rep bigint, words binary", "keys": "key int, rep bigint, n int, s1 bigint, s2 bigint, s3 bigint, s4 bigint", "bare": "hash string, id bigint, seed boolean"}


class HistoryIndex:
    """The written index of everything accepted: ``check`` pairs the rows of a batch with rows they repeat and appends them.

    ``parts`` is set by the first load; an index that is opened again at its ``path`` is given the same number.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int | None = None):
        self.spark, self.parts = spark, parts
        self.path = path or new_folder(spark, "history")

    def part(self, column: str) -> F.Column:
        """Part of a value; keys go by their lower half, as the upper half is stored."""
        return F.pmod(F.col(column) if column == "k" else F.xxhash64(column), F.lit(self.parts)).cast("int")

    def table(self, name: str, parts: DataFrame | None = None) -> DataFrame:
        """A table of the index, or only the parts named in the one column of ``parts``."""
        try:
            found = self.spark.read.schema(f"{TABLES[name]}, part int").parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing appended yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TABLES[name])
        if parts is not None and self.parts >= MANY_PARTS:
            found = found.where(F.col("part").isin([r[0] for r in parts.distinct().collect()]))  # at most as many numbers as parts
        return found.drop("part")

    def met(self, name: str, by: str, wanted: DataFrame, part: str | None = None) -> DataFrame:
        """The rows of a table whose ``by`` may stand in ``wanted``: of the parts it falls into, those that set the same bit of a filter of fixed size.

        ``part`` names the column of ``wanted`` that gives the part, where it is not ``by``.
        """
        held = self.table(name, wanted.select(self.part(part or by)))
        return looked_up(held, by, wanted).where("hit").select(*held.columns)

    def _add(self, name: str, rows: DataFrame, by: str) -> None:
        rows.withColumn("part", self.part(by)).drop("k").repartition("part").write.mode("append").partitionBy("part").parquet(f"{self.path}/{name}")

    def _texts(self, prepared: DataFrame, written: list[str]) -> DataFrame:
        """``class, rep, fresh, words, keys`` and sketch: every class of a batch once, with its representative and whether the index had none before."""
        held = prepared.where("class IS NOT NULL")
        known = self.met("classes", "class", held.select("class"))
        again = held.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
        seen = looked_up(held, "class", again.unionByName(known.select("class")))
        alone = seen.where("NOT hit").select("class", F.col("id").alias("rep"), F.lit(True).alias("fresh"), "words", "keys", *SKETCHED)  # its text stays where it is
        one = seen.where("hit").groupBy("class").agg(F.min(F.struct("id", "words", "keys", *SKETCHED)).alias("t"))
        found = one.join(known, "class", "left").select("class", F.coalesce("rep", "t.id").alias("rep"), F.col("rep").isNull().alias("fresh"), "t.words", "t.keys", *(f"t.{s}" for s in SKETCHED))
        return materialize(alone.unionByName(found), "batch-texts", written)

    def append(self, prepared: DataFrame, seed: bool = False) -> None:
        """Adds prepared rows; wordings that the index holds already get no second set of keys."""
        if self.parts is None:
            self.parts = max(1, prepared.count() // PART_ROWS)
        written: list[str] = []
        self._append(prepared, self._texts(prepared, written), seed)
        discard(self.spark, written)

    def _append(self, prepared: DataFrame, texts: DataFrame, seed: bool) -> None:
        fresh = texts.where("fresh")
        self._add("keys", exploded(fresh), "k")
        self._add("texts", fresh.select("rep", "words"), "rep")
        self._add("classes", fresh.select("class", "rep"), "class")
        self._add("members", self._members(prepared, texts, seed), "rep")
        self._add("bare", self._bare(prepared, seed), "hash")

    @staticmethod
    def _members(prepared: DataFrame, texts: DataFrame, seed: bool) -> DataFrame:
        return prepared.where("class IS NOT NULL").select("class", "id").join(texts.select("class", "rep"), "class").select("rep", "id", F.lit(seed).alias("seed")).distinct()

    @staticmethod
    def _bare(prepared: DataFrame, seed: bool) -> DataFrame:
        return prepared.where("class IS NULL AND hash <> ''").select("hash", "id", F.lit(seed).alias("seed")).distinct()

    def links(self, texts: DataFrame, written: list[str]) -> DataFrame:
        """``a < b``: linked representatives, one of them a class of the batch (``texts``)."""
        keys = materialize(exploded(texts), "batch-keys", written)
        held = materialize(self.met("keys", "key", keys, "k"), "met-keys", written)
        candidates = materialize(candidate_pairs(keys.drop("k"), held, written), "candidates", written)
        asked = candidates.select(F.explode(F.array("a", "b")).alias("rep"))
        words = materialize(self.met("texts", "rep", asked).unionByName(texts.where("fresh").select("rep", "words")), "met-texts", written)
        return materialize(verify(candidates, words), "links", written)

    def check(self, prepared: DataFrame) -> DataFrame:
        """``id_a, id_b``: pairs of a row of the batch with a row of the index or of the batch that holds the same document, smaller id first.

        ``id_b`` is never a row of the first load. The batch is appended afterwards.
        """
        if self.parts is None:
            self.parts = max(1, prepared.count() // PART_ROWS)
        written: list[str] = []
        texts = self._texts(prepared, written)
        links = self.links(texts, written)
        new = materialize(self._members(prepared, texts, False), "batch-members", written)
        both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
        near = both.join(texts.select("rep"), "rep", "left_semi").unionByName(texts.select("rep", F.col("rep").alias("other")))
        near = materialize(near, "near-classes", written)
        members = self.met("members", "rep", near.select(F.col("other").alias("rep"))).unionByName(new)
        members = materialize(members.select(F.col("rep").alias("other"), F.struct("id", "seed").alias("a")), "met-members", written)
        met = materialize(salted_join(near, members, "other", written).select("rep", "a"), "near-members", written)
        met = salted_join(new.select("rep", F.struct("id", "seed").alias("b")), met, "rep", written).select("a", "b")
        bare = materialize(self._bare(prepared, False), "batch-bare", written)
        others = materialize(self.met("bare", "hash", bare).unionByName(bare).select("hash", F.struct("id", "seed").alias("a")), "met-bare", written)
        hashed = salted_join(bare.select("hash", F.struct("id", "seed").alias("b")), others, "hash", written).select("a", "b")
        pairs = met.unionByName(hashed).where("a.id <> b.id").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("NOT b.seed")
        pairs = materialize(pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct(), "batch-pairs")
        self._append(prepared, texts, False)
        discard(self.spark, written)
        return pairs


def exploded(texts: DataFrame) -> DataFrame:
    """``k, key, rep, n`` and sketch: a row for every band key, with the number of words."""
    of = texts.select(F.explode("keys").alias("k"), "rep", (F.length("words") / 4).cast("int").alias("n"), *SKETCHED)
    return of.select("k", F.shiftright("k", 32).cast("int").alias("key"), "rep", "n", *SKETCHED)


def candidate_pairs(new: DataFrame, met: DataFrame, written: list[str]) -> DataFrame:
    """Distinct ``a < b`` of representatives that share a band key and most of their sketch, one of them new. Hot keys are salted."""
    few = new.select("key", F.col("rep").alias("x"), F.col("n").alias("nx"), *(F.col(s).alias(f"x{s[1]}") for s in SKETCHED))
    many = met.unionByName(new).select("key", F.col("rep").alias("y"), F.col("n").alias("ny"), *(F.col(s).alias(f"y{s[1]}") for s in SKETCHED))
    low, high = F.least("nx", "ny"), F.greatest("nx", "ny")
    alike = SHARE * high / (low + (1 - SHARE) * high)  # the least share of all words that two texts of these lengths have in common
    agree = SKETCH - F.expr("bit_count((x1 ^ y1) | (x3 ^ y3)) + bit_count((x2 ^ y2) | (x4 ^ y4))")
    equal = (1 + 3 * alike) / 4  # the share of the hashes whose two bits then agree
    pairs = salted_join(few, many, "key", written).where("x <> y").where(low >= SHARE * high)
    pairs = pairs.where(agree >= SKETCH * equal - DEVIATIONS * F.sqrt(SKETCH * equal * (1 - equal)))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, share: float = SHARE) -> DataFrame:
    """The pairs whose texts are the same document; ``texts`` has ``rep, words``."""
    joined = pairs.join(texts.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [same_document(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), share) for x, y in zip(batch["wa"], batch["wb"])]
            yield batch.loc[keep, ["a", "b"]]

    return joined.mapInPandas(run, "a bigint, b bigint")


def check_batches(history: DataFrame, incoming: DataFrame, order: str = "batch_no", most: int = 1_000, index: HistoryIndex | None = None) -> DataFrame:
    """``id_a, id_b, batch`` of all rows of ``incoming`` and the rows of history or incoming that they repeat, batch after batch.

    Two rows with text repeat each other if at least 80 in 100 words of the longer stand in the other in
    order; two rows without (null, empty, or no word at all) if their hashes are equal, ignoring case; a null
    or empty hash equals nothing, and the hash of a row with text decides nothing. Equal wordings are one class:
    classes are compared, rows put back afterwards. Rows without a batch number (or a table without that column) come last, as one batch (``batch`` null). Empty
    tables give no pairs; repeated rows of one id count once; further columns are not read. The number
    of batches is small and is refused above ``most``.
    """
    spark = incoming.sparkSession
    if order not in incoming.columns:
        incoming = incoming.withColumn(order, F.lit(None).cast("int"))
    index = index or HistoryIndex(spark)
    written: list[str] = []
    index.append(materialize(prepare(history), "prepared", written), seed=True)
    discard(spark, written)
    out = spark.createDataFrame([], "id_a bigint, id_b bigint, batch int")
    numbers = sorted((r[0] for r in incoming.select(order).distinct().limit(most + 1).collect()), key=lambda n: (n is None, n or 0))
    if len(numbers) > most:
        raise ValueError(f"more than {most} batches")
    for n in numbers:
        batch = materialize(prepare(incoming.where(F.col(order).eqNullSafe(F.lit(n)))), "prepared", written)
        out = out.unionByName(index.check(batch).withColumn("batch", F.lit(n).cast("int")))
        discard(spark, written)
    return out


def repeated_rows(history: DataFrame, incoming: DataFrame, order: str = "batch_no") -> DataFrame:
    """``id_a, id_b``: the pairs of :func:`check_batches`."""
    return check_batches(history, incoming, order).select("id_a", "id_b").distinct()


def link_counts(pairs: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per row of ``incoming``: ``id``, the first row that holds the same document (itself if none), and with how many rows it is linked."""
    both = pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("other")).unionByName(pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")))
    found = both.groupBy("id").agg(F.min("other").alias("first"), F.count("*").alias("links"))
    return incoming.select("id").dropna().distinct().join(found, "id", "left").select("id", F.least("id", F.coalesce("first", "id")).alias("first_id"), F.coalesce("links", F.lit(0)).alias("links"))
