"""The k most similar vectors for every vector, by an inverted index with adaptive dimension scan.

Vectors are scaled to length 1, rotated at random and assigned to the lists of a clustering fitted on a
bounded sample. The lists are written once to the shared folder. One task takes the queries of a
list, reads the lists they probe in column blocks, and abandons a candidate as soon as a test on
its partial product says that it cannot reach the query's k-th best.

Vectors that agree to five decimals form one class: a class is searched once, and its members are
put back afterwards, so that a group of copies of any size costs one search.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from leafstack.session import materialize, new_folder

#: Bounds of the sample that the lists are fitted on (vectors per group of comparable rows), of the lists, and of groups.
SAMPLE, MOST_LISTS, MOST_GROUPS = 16_384, 4_096, 1_000
LIST_SIZE, QUERY_BLOCK, BLOCK_ROWS = 512, 1_024, 8_192
#: Share of true neighbours in the sample that the probed lists must hold.
TARGET_RECALL = 0.95
#: Standard deviations by which a candidate must miss the k-th best to be abandoned.
ABANDON_Z = 3.0


def decode_row(chunks_json: str | None, blob: str | None) -> np.ndarray | None:
    """Vectors of one stored row, or None unless it is valid base64 of vectors of one width for the array elements."""
    if not chunks_json or not blob:
        return None
    try:
        elements = json.loads(chunks_json)
        raw = base64.b64decode(blob, validate=True)
    except (ValueError, binascii.Error, RecursionError):
        return None
    if not isinstance(elements, list) or not elements or not raw or len(raw) % (4 * len(elements)):
        return None
    return np.frombuffer(raw, "<f4").reshape(len(elements), -1).astype(np.float64)


def decode_passages(history: DataFrame) -> DataFrame:
    """``id, passage, grp, dims, vector`` (unit length, binary float32) and ``class`` of every passage of a row whose string can be cut evenly.

    Rows without passages, vectors or model and damaged strings are left out, as are vectors of length 0 or with a value that is not
    finite. ``grp`` is model and scheme; a null scheme counts as ``page``. ``dims`` is the width that the row's own string
    gives: :func:`most_similar` keeps the width that most passages of a group have, so a string with too few or too many vectors drops out there.
    """
    rows = history.select("id", "content_chunks_json", "content_embeddings_b64", "embedding_model", F.coalesce("chunk_scheme", F.lit("page")).alias("scheme"))
    rows = rows.where(F.col("content_embeddings_b64").isNotNull() & F.col("content_chunks_json").isNotNull() & F.col("embedding_model").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, chunks, blob, model, scheme in batch.itertuples(index=False):
                vectors = decode_row(chunks, blob)
                if vectors is None:
                    continue
                norms = np.linalg.norm(vectors, axis=1)
                for p in np.flatnonzero(np.isfinite(norms) & (norms > 0)):
                    unit = vectors[p] / norms[p]
                    key = hashlib.blake2b((np.round(unit, 5) + 0.0).astype("<f4").tobytes() + f"{model}|{scheme}".encode(), digest_size=12).hexdigest()
                    out.append((i, int(p), f"{model}|{scheme}", vectors.shape[1], unit.astype("<f4").tobytes(), key))
            yield pd.DataFrame(out, columns=["id", "passage", "grp", "dims", "vector", "class"])

    return rows.mapInPandas(run, "id bigint, passage int, grp string, dims int, vector binary, class string")


def of_one_width(passages: DataFrame) -> DataFrame:
    """The passages of the width that most of their group have (the larger of two that are even)."""
    seen = passages.groupBy("grp", "dims").agg(F.count("*").alias("n"))
    main = seen.groupBy("grp").agg(F.max_by("dims", F.struct("n", "dims")).alias("dims"))
    return passages.join(F.broadcast(main.limit(MOST_GROUPS + 1)), ["grp", "dims"], "left_semi")  # more groups are refused below


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres (unit length) of a spherical k-means over ``sample``."""
    rng = np.random.default_rng(11)
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        owner = np.concatenate([np.argmax(part @ centres.T, 1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        norms = np.linalg.norm(sums, axis=1)
        alive = norms > 1e-9
        centres[alive] = sums[alive] / norms[alive, None]
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, target: float, queries: int = 256) -> int:
    """Lists to probe so that, within the sample, a share ``target`` of the k nearest is seen."""
    if len(centres) == 1 or len(sample) <= k:
        return 1
    owner = np.argmax(sample @ centres.T, 1)
    ask = np.random.default_rng(13).choice(len(sample), min(queries, len(sample)), replace=False)
    scores = sample[ask] @ sample.T
    scores[np.arange(len(ask)), ask] = -2
    near = np.argpartition(-scores, k, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(sample[ask] @ centres.T), axis=1), axis=1)
    ranks = np.take_along_axis(order, owner[near], axis=1).ravel() + 1
    return int(np.quantile(ranks, target, method="higher"))


def scan_list(queries: np.ndarray, own: np.ndarray, bases: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` of the candidates for each query: arrays of query row, candidate number, cosine.

    ``bases`` yields (rows of ``queries`` that probe it, candidate numbers, vectors); ``own`` holds
    each query's own number. Products go by column blocks. After each block a candidate stays only while its
    partial product plus ``z`` standard deviations of the rest reaches the query's k-th best.
    """
    dims = queries.shape[1]
    edges = [0, dims // 2, dims]
    floor = np.full(len(queries), -2.0, np.float32)
    rest_q = [np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", queries[:, :e], queries[:, :e]))) for e in edges[1:]]
    rows = np.empty(0, np.int64)
    nums = np.empty(0, np.int64)
    vals = np.empty(0, np.float32)
    held = 0
    for who, numbers, vectors in bases:
        q = queries[who]
        part = q[:, : edges[1]] @ vectors[:, : edges[1]].T
        rest_v = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", vectors[:, : edges[1]], vectors[:, : edges[1]])))
        slack = (z / np.sqrt(dims - edges[1])) * rest_q[0][who]
        live = part + slack[:, None] * rest_v[None, :] >= floor[who][:, None]
        share = live.mean()
        if share > 0.05:
            part += q[:, edges[1] :] @ vectors[:, edges[1] :].T
            a, b = np.nonzero(live & (part >= floor[who][:, None]))
            v = part[a, b]
        else:
            a, b = np.nonzero(live)
            v = part[a, b] + np.einsum("ij,ij->i", q[a, edges[1] :], vectors[b, edges[1] :])
            keep = v >= floor[who][a]
            a, b, v = a[keep], b[keep], v[keep]
        other = numbers[b] != own[who][a]
        rows = np.concatenate([rows, who[a[other]]])
        nums = np.concatenate([nums, numbers[b[other]]])
        vals = np.concatenate([vals, v[other]])
        if len(rows) > held + 24 * k * 8 or held == 0:
            rows, nums, vals = _best(rows, nums, vals, k)
            held = len(rows)
            full = np.flatnonzero(np.bincount(rows, minlength=len(queries)) >= k)
            low = np.full(len(queries), 9.0, np.float32)
            np.minimum.at(low, rows, vals)
            floor[full] = low[full]
    return _best(rows, nums, vals, k)


def _best(rows: np.ndarray, nums: np.ndarray, vals: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((nums, -vals, rows))
    rows, nums, vals = rows[order], nums[order], vals[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], nums[keep], vals[keep]


def list_blocks(root: str, grp: int, number: int, first: int = 0, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and vectors of a list of the index, in blocks of rows, from row ``first`` on."""
    if first == 0 and most is None:
        yield from _small_list(root, grp, number) or _read_blocks(root, grp, number)
        return
    at = 0
    for seqs, vectors in list_blocks(root, grp, number):
        low, high = max(first - at, 0), min(first + most - at, len(seqs))
        if low < high:
            yield seqs[low:high], vectors[low:high]
        at += len(seqs)
        if at >= first + most:
            return


def _read_blocks(root: str, grp: int, number: int, rows: int = BLOCK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root.replace("s3a://", "s3://"))
    for f in sorted(system.get_file_info(fs.FileSelector(f"{path}/grp={grp}/list={number}")), key=lambda x: x.path):
        if f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(rows, columns=["seq", "vector"]):
                    yield batch["seq"].to_numpy(), np.frombuffer(b"".join(batch["vector"].to_pylist()), "<f4").reshape(batch.num_rows, -1)


@lru_cache(maxsize=64)
def _small_list(root: str, grp: int, number: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """The list if it is one block, kept for the next queries of this worker; None if it is larger."""
    blocks = _read_blocks(root, grp, number)
    first = [next(blocks)]
    return first if next(blocks, None) is None else None


def nearest_classes(classes: DataFrame, k: int, list_size: int = LIST_SIZE, target: float = TARGET_RECALL, sample: int = SAMPLE) -> DataFrame:
    """``seq`` of each class with ``near``: up to ``k`` other classes of its group and their cosines.

    ``classes`` has ``seq`` (number), ``class``, ``grp`` and ``vector``, one row per class.
    """
    spark = classes.sparkSession
    counts = sorted((r[0], r[1]) for r in classes.groupBy("grp").count().limit(MOST_GROUPS + 1).collect())
    schema = "seq bigint, near array<struct<cos:double,seq:bigint>>"
    if not counts:
        return spark.createDataFrame([], schema)
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    models: dict[str, tuple] = {}
    for number, (grp, n) in enumerate(counts):
        some = classes.where(F.col("grp") == grp).orderBy(F.xxhash64("class")).limit(sample).select("vector").collect() if n <= sample else classes.where((F.col("grp") == grp) & (F.shiftrightunsigned(F.xxhash64("class"), 33) < F.lit(int(2**31 * sample * 0.97 / n)))).limit(sample).select("vector").collect()
        data = np.stack([np.frombuffer(r[0], "<f4") for r in some])
        turn = rotation(data.shape[1])
        data = data @ turn
        lists = max(1, min(MOST_LISTS, round(n / list_size), len(data)))
        centres = fit_lists(data, lists)
        models[grp] = (number, turn, centres, probes_needed(data, centres, k, target))
    shared = spark.sparkContext.broadcast(models)  # at most MOST_LISTS centres a group

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, part in batch.groupby("grp", sort=False):
                number, turn, centres, _ = shared.value[grp]
                x = np.frombuffer(b"".join(part["vector"]), "<f4").reshape(len(part), -1) @ turn
                yield pd.DataFrame({"seq": part["seq"].to_numpy(), "class": part["class"].to_numpy(), "vector": [v.tobytes() for v in x], "grp": np.full(len(x), number, np.int32), "list": np.argmax(x @ centres.T, 1).astype(np.int32)})

    placed = classes.select("seq", "class", "grp", "vector").mapInPandas(assign, "seq bigint, class string, vector binary, grp int, list int")
    root = new_folder(spark, "vector-lists")
    placed.repartition("grp", "list").sortWithinPartitions("grp", "list").write.partitionBy("grp", "list").parquet(root)
    sizes = spark.read.parquet(root).groupBy(F.col("grp").cast("int").alias("grp"), F.col("list").cast("int").alias("list")).count()
    there = {(r[0], r[1]) for r in sizes.select("grp", "list").collect()}  # at most MOST_LISTS a group
    by_number = {m[0]: m for m in models.values()}
    centres = spark.sparkContext.broadcast({n: (m[2], m[3]) for n, m in by_number.items()})
    present = spark.sparkContext.broadcast(there)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, number, start in batch.itertuples(index=False):
                parts = list(list_blocks(root, grp, number, start, QUERY_BLOCK))
                own, mine = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                centre, probes = centres.value[grp]
                scores = mine @ centre.T
                chosen = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
                asked = np.zeros(scores.shape, bool)
                np.put_along_axis(asked, chosen, True, axis=1)
                asked[:, number] = True
                order = [number, *(j for j in np.argsort(-scores.mean(0)) if j != number)]

                def bases() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                    for j in order:
                        who = np.flatnonzero(asked[:, j])
                        if len(who) and (grp, int(j)) in present.value:
                            for s, v in list_blocks(root, grp, int(j)):
                                yield who, s, v

                rows, nums, vals = scan_list(mine, own, bases(), k, ABANDON_Z)
                ends = np.searchsorted(rows, np.arange(len(own) + 1))
                near = [[{"cos": float(c), "seq": int(s)} for c, s in zip(vals[a:b], nums[a:b])] for a, b in zip(ends[:-1], ends[1:])]
                yield pd.DataFrame({"seq": own, "near": near})

    jobs = sizes.select("grp", "list", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"), F.lit(QUERY_BLOCK))).alias("start"))
    lists = sum(len(m[2]) for m in models.values())
    return jobs.repartition(max(1, min(max(lists, sum(n for _, n in counts) // QUERY_BLOCK), 4 * spark.sparkContext.defaultParallelism)), "grp", "list", "start").mapInPandas(search, schema)


def most_similar(passages: DataFrame, k: int = 10, **fit) -> DataFrame:
    """``id, passage, rank, other_id, other_passage, cos``: the ``k`` most similar others of every passage.

    ``passages`` is the result of :func:`decode_passages`. Only rows of one group are compared. Equal
    cosines go by (id, passage). A group of fewer than ``k + 1`` passages gives what it has; an empty table
    gives no row. Neighbours are approximate: ``tests/llm`` measures the recall.
    """
    rows = of_one_width(materialize(passages.dropDuplicates(["id", "passage", "class"]), "passages"))
    key = F.struct("id", "passage")
    classes = rows.groupBy("grp", "class").agg(F.min(F.struct("id", "passage", "vector")).alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.select("grp", "class", "n", F.struct("first.id", "first.passage").alias("first"), F.col("first.vector").alias("vector"), F.monotonically_increasing_id().alias("seq")), "vector-classes")
    near = materialize(nearest_classes(classes, k, **fit), "nearest-classes")
    info = classes.select("seq", "grp", "class", "n", "first")
    edges = near.select("seq", F.explode("near").alias("e")).select("seq", "e.cos", F.col("e.seq").alias("other"))
    edges = edges.join(info.select(F.col("seq").alias("other"), F.col("first").alias("o_first"), F.col("n").alias("o_n"), F.col("class").alias("o_class")), "other")
    # the first k + 1 members of classes with more than one
    many = rows.join(info.where("n > 1").select("class", "seq"), "class")
    firsts = many.withColumn("r", F.row_number().over(W.partitionBy("seq").orderBy("id", "passage"))).where(F.col("r") <= k + 1).select(F.col("seq").alias("other"), key.alias("member"))
    single = edges.where("o_n = 1").select("seq", "cos", F.col("o_first").alias("member"))
    spread = edges.where("o_n > 1").select("seq", "cos", "other").join(firsts, "other").select("seq", "cos", "member")
    own = firsts.select(F.col("other").alias("seq"), F.lit(1.0).alias("cos"), "member")
    best = single.unionByName(spread).unionByName(own).withColumn("r", F.row_number().over(W.partitionBy("seq").orderBy(F.desc("cos"), "member"))).where(F.col("r") <= k + 1)
    best = best.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("r", "cos", "member"))).alias("list"))
    members = info.where("n = 1").select("seq", F.col("first").alias("me")).unionByName(many.select("seq", key.alias("me")))
    got = members.join(best, "seq").withColumn("list", F.slice(F.filter("list", lambda x: x["member"] != F.col("me")), 1, k))
    got = got.select("me.id", "me.passage", F.posexplode("list").alias("rank", "o"))
    return got.select("id", "passage", (F.col("rank") + 1).alias("rank"), F.col("o.member.id").alias("other_id"), F.col("o.member.passage").alias("other_passage"), F.col("o.cos").alias("cos"))


def similar_pairs(neighbours: DataFrame, least: float = 0.9) -> DataFrame:
    """Distinct pairs with a cosine of at least ``least``, the smaller key first."""
    a, b = F.struct(F.col("id").alias("id"), F.col("passage").alias("p")), F.struct(F.col("other_id").alias("id"), F.col("other_passage").alias("p"))
    pairs = neighbours.where(F.col("cos") >= least - 1e-6).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return pairs.select(F.col("a.id").alias("id_a"), F.col("a.p").alias("passage_a"), F.col("b.id").alias("id_b"), F.col("b.p").alias("passage_b"))
