"""Filling containers of fixed capacity with texts, by harmonic packing.

Lengths fall into classes of reciprocal capacity: class ``k`` holds the lengths in
``(C / (k + 1), C / k]`` and exactly ``k`` of its items fill one container. Shards of bounded size
are packed independently of each other; inside a shard the room that a class leaves in its
containers is topped up with the largest items of the finer classes that fit.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leafstack.llm.tokens import DEFAULT_VOCABULARY, count_tokens
from leafstack.session import materialize

#: Items that one shard holds on average; a shard is packed in one task.
SHARD_ITEMS = 20_000
#: Settings are a small table by definition; more rows than this are refused.
MOST_SETTINGS = 1_000

PACKED = "setting_id int, shard int, bin int, slot int, doc_id {key}, piece_index int, token_start int, n_tokens int, capacity_tokens int"


def harmonic_bins(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` (each 1 to ``capacity``) by container.

    Longest first: a container opened by an item of class ``k`` takes the next ``k - 1`` items of that
    class, then, while room is left, the longest remaining item that fits. Ties go by index.
    """
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], -i))
    sizes = [lengths[i] for i in order]
    bins: list[list[int]] = []
    while order:
        head = sizes[-1]
        k = capacity // head
        least = capacity // (k + 1) + 1
        room, bag = capacity, []
        for _ in range(k):
            if not order or sizes[-1] < least or sizes[-1] > room:
                break
            room -= sizes.pop()
            bag.append(order.pop())
        while order and room >= sizes[0]:
            at = bisect_right(sizes, room) - 1
            room -= sizes.pop(at)
            bag.append(order.pop(at))
        bins.append(bag)
    return bins


def token_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, *extra: str) -> DataFrame:
    """``key``, ``extra`` columns and ``n_tokens`` of every row, written once to the shared folder."""
    return materialize(docs.select(F.col(key), *(F.col(c) for c in extra), count_tokens(F.col(text), vocabulary).alias("n_tokens")), "token-lengths")


def pack_lengths(lengths: DataFrame, settings: DataFrame, key: str = "doc_id", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers for items with ``n_tokens``, once per row of ``settings``.

    Returns ``setting_id, container_id, slot, key, piece_index, token_start, n_tokens,
    capacity_tokens``. An item longer than the capacity, and no other, is split: into pieces of
    exactly the capacity, which fill a container each, and a rest that is packed like any item.
    Rows without tokens (null or empty texts) need no room and give no row; repeated rows are
    packed as often as they stand; settings with a null or non-positive capacity are left out; an
    empty table gives no container. Shards are drawn by row, not by key, so that a hot key
    spreads; the items of a shard are ids and lengths only.
    """
    rules = settings.select(F.col("setting_id").cast("int"), F.col("capacity_tokens").cast("int")).where("capacity_tokens > 0").distinct().limit(MOST_SETTINGS + 1).collect()
    if len(rules) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    kind = lengths.schema[key].dataType.simpleString()
    schema = PACKED.format(key=kind)
    spark = lengths.sparkSession
    if not rules:
        return spark.createDataFrame([], schema).select("setting_id", F.lit("").alias("container_id"), "slot", F.col("doc_id").alias(key), "piece_index", "token_start", "n_tokens", "capacity_tokens")
    shards = -(-lengths.count() // shard_items) or 1
    each = F.explode(F.array(*(F.struct(F.lit(r[0]).alias("setting_id"), F.lit(r[1]).alias("capacity")) for r in rules)))
    rows = lengths.where("n_tokens > 0").select(F.col(key).alias("doc_id"), "n_tokens", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), each.alias("s"))
    rows = rows.select("s.setting_id", "s.capacity", "shard", "doc_id", "n_tokens")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "n_tokens"], kind="stable")
        setting, capacity, shard = int(group["setting_id"].iat[0]), int(group["capacity"].iat[0]), int(group["shard"].iat[0])
        out, items, at = [], [], 0
        for doc, n in zip(group["doc_id"].tolist(), group["n_tokens"].tolist()):
            full, rest = divmod(n, capacity)
            if n <= capacity:
                full, rest = 0, n
            for p in range(full):
                out.append((setting, shard, at, 0, doc, p, p * capacity, capacity, capacity))
                at += 1
            if rest:
                items.append((doc, full, full * capacity, rest))
        for b, bag in enumerate(harmonic_bins([i[3] for i in items], capacity), at):
            out.extend((setting, shard, b, slot, *items[i], capacity) for slot, i in enumerate(bag))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    packed = rows.groupBy("setting_id", "shard").applyInPandas(run, schema)
    return packed.select("setting_id", F.concat_ws("-", "setting_id", "shard", "bin").alias("container_id"), "slot", F.col("doc_id").alias(key), "piece_index", "token_start", "n_tokens", "capacity_tokens")


def pack_report(packed: DataFrame) -> DataFrame:
    """Per setting: containers, items, tokens, free room, fill and the least possible number of containers."""
    per = packed.groupBy("setting_id", "capacity_tokens", "container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return per.groupBy("setting_id", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        (F.count("*") * F.first("capacity_tokens") - F.sum("tokens")).alias("free_tokens"),
        F.round(F.sum("tokens") / (F.count("*") * F.first("capacity_tokens")), 6).alias("fill"),
        F.ceil(F.sum("tokens") / F.first("capacity_tokens")).alias("least_containers"),
    )
