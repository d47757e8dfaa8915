"""Running sums in two levels, so that one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def running_sum(rows: DataFrame, key: str, order: str, value: str, out: str, descending: bool = False, block: int = 4096) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of the key up to this one, by the whole number ``order``.

    Rows are cut into blocks of ``order``; sums of blocks are added up first, then the rows within each block, so
    no task sorts more than a block of a key. Equal orders share their sum; null values count 0; a null key is a key.
    """
    cut = rows.withColumn("__b", F.floor(F.col(order) / block))
    way = F.desc if descending else F.asc
    sums = cut.groupBy(F.col(key).alias("__k"), F.col("__b").alias("__bb")).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__s"))
    before = sums.withColumn("__before", F.sum("__s").over(W.partitionBy("__k").orderBy(way("__bb"))) - F.col("__s")).drop("__s")
    inside = F.sum(F.coalesce(F.col(value), F.lit(0))).over(W.partitionBy(key, "__b").orderBy(way(order)))
    joined = cut.withColumn("__in", inside).join(before, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__bb")))
    return joined.withColumn(out, F.col("__before") + F.col("__in")).drop("__b", "__k", "__bb", "__before", "__in")
