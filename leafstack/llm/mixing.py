"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight over training time ``t`` in [0, 1], linear from ``share * (1 - tilt)`` to
``share * (1 + tilt)``, so that its integral is the target share. A document whose tokens stand at
cumulative demand ``c`` of its source is trained at the time when the integral of the source's
weight reaches ``c`` over the budget; documents are then range-sorted by that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Sources are bounded by the table of targets; more rows than this are refused.
MOST_SOURCES = 10_000
#: Rows that one bucket of the running sums holds on average.
BUCKET_ROWS = 50_000
#: How strongly the weight of repeated (scarce) sources rises over time.
SCARCE_TILT = 0.5


def plan_mix(totals: dict[str, int], targets: list[tuple[str, float, int]], scarce_tilt: float = SCARCE_TILT) -> tuple[float, dict[str, dict]]:
    """Token budget and per source: share, demand, tilt, available tokens.

    The budget is the largest at which every source can give its share within its repeats. Sources
    without tokens cannot take part: the other shares are scaled to 1. Tilts cancel at every time,
    so the weights always sum to 1.
    """
    usable = [(s, w, r) for s, w, r in targets if w > 0 and r > 0 and totals.get(s, 0) > 0]
    if not usable:
        return 0.0, {}
    whole = sum(w for _, w, _ in usable)
    budget = min(r * totals[s] * whole / w for s, w, r in usable)
    plan = {s: {"share": w / whole, "demand": budget * w / whole, "tokens": totals[s], "repeats": r} for s, w, r in usable}
    scarce = {s for s, p in plan.items() if p["demand"] > p["tokens"]}
    rising = sum(plan[s]["share"] for s in scarce)
    for s, p in plan.items():
        both = 0 < rising < 1
        up = min(scarce_tilt, (1 - rising) / rising) if both else 0.0
        p["tilt"] = 0.0 if not both else up if s in scarce else -up * rising / (1 - rising)
    return budget, plan


def mix_sources(lengths: DataFrame, targets: DataFrame, key: str = "doc_id", bucket_rows: int = BUCKET_ROWS, scarce_tilt: float = SCARCE_TILT) -> DataFrame:
    """Training order of documents with ``key, source, n_tokens``; a document stands once per use.

    Returns ``position`` (time in [0, 1]), ``token_offset``, ``key``, ``source``, ``use`` (from 1) and
    ``n_tokens``, range-partitioned and sorted by position. A source gives its share of the budget
    to within one document; no key is used more than ``max_repeats`` times. Rows without tokens or
    whose source is null or no target take no part; rows that repeat a key count once (the
    longest). With no usable source the result is empty. Of a source named twice in ``targets``
    the larger row counts. Running sums go by hash buckets, so one source may hold all rows.
    """
    spark = lengths.sparkSession
    named = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna().groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").limit(MOST_SOURCES + 1).collect()
    if len(named) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wanted = [r[0] for r in named]
    rows = lengths.where((F.col("n_tokens") > 0) & F.col("source").isin(wanted)).groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(F.col("n_tokens").cast("long").alias("n_tokens"), "source")).alias("r")).select("__key", "r.source", "r.n_tokens")
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()
    budget, plan = plan_mix({r[0]: r[1] for r in sums}, [tuple(r) for r in named], scarce_tilt)
    schema = "position double, token_offset double, doc_id {}, source string, use int, n_tokens bigint".format(lengths.schema[key].dataType.simpleString())
    if not plan:
        return spark.createDataFrame([], schema).withColumnRenamed("doc_id", key)
    rules = spark.createDataFrame([(s, p["share"], p["demand"], p["tilt"], float(p["tokens"])) for s, p in plan.items()], "source string, share double, demand double, tilt double, available double")
    buckets = max(16, sum(r[2] for r in sums) // bucket_rows)
    uses = rows.join(F.broadcast(rules), "source").withColumn("use", F.explode(F.sequence(F.lit(1), F.ceil(F.col("demand") / F.col("available")).cast("int"))))
    uses = uses.withColumn("h", F.xxhash64("__key", "use")).withColumn("bucket", F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(2**63))) * buckets).cast("int")).withColumn("h", F.shiftrightunsigned("h", 1))
    before = uses.groupBy("source", "use", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = before.withColumn("before", F.sum("in_bucket").over(W.partitionBy("source", "use").orderBy("bucket")) - F.col("in_bucket")).drop("in_bucket")
    run = F.sum("n_tokens").over(W.partitionBy("source", "use", "bucket").orderBy("h", "__key").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    at = uses.join(before, ["source", "use", "bucket"]).withColumn("at", (F.col("use") - 1) * F.col("available") + F.col("before") + run + F.col("n_tokens") / 2)
    # W(t) = share * ((1 - tilt) t + tilt t^2); the root in [0, 1] of W(t) = at / budget
    c = F.least(F.col("at") / F.col("demand"), F.lit(1.0))
    root = F.when(F.abs("tilt") < 1e-9, c).otherwise((F.sqrt((1 - F.col("tilt")) * (1 - F.col("tilt")) + 4 * F.col("tilt") * c) - (1 - F.col("tilt"))) / (2 * F.col("tilt")))
    used = at.where("at <= demand").select(root.alias("position"), (root * budget).alias("token_offset"), F.col("__key").alias(key), "source", "use", "n_tokens")
    return used.repartitionByRange(F.col("position"), F.col(key)).sortWithinPartitions("position", key, "use")


def mix_report(mixed: DataFrame, lengths: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per target source: share wanted and reached, documents, uses, most uses of one document, tokens."""
    per = mixed.groupBy("source", key).agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"))
    got = per.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    have = lengths.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    joined = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").join(have, "source", "left").fillna(0, ["documents", "uses", "most_uses", "tokens", "available_tokens"])
    return joined.withColumn("share_reached", F.coalesce(F.round(F.col("tokens") / F.sum("tokens").over(W.partitionBy()), 6), F.lit(0.0)))
