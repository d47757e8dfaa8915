"""Evaluation of retrieval: hits, ranks, margins, collisions, roll-ups; and the tail of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafstack.functions import text as T
from leafstack.operators.running import running_sum


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("q_id", "doc_id").agg(F.max("score").alias("best"), F.min("pos").alias("first_pos"))


def answer_ranks(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """1-based rank of the expected sources by best score: the first of them, and the last if all are there, else 0."""
    best = _best(scored)
    wanted = expected.select("q_id", F.size("expected").alias("n"), F.explode("expected").alias("doc_id"))
    mine = wanted.join(best, ["q_id", "doc_id"], "left").select("q_id", "n", "doc_id", F.col("best").alias("b"), F.col("first_pos").alias("p"))
    # a rank is one more than the number of sources that do better: counted, not sorted, so no task holds all sources of a question
    ahead = (F.col("best") > F.col("b")) | ((F.col("best") == F.col("b")) & (F.col("first_pos") < F.col("p")))
    ranks = mine.join(best.select("q_id", "best", "first_pos"), "q_id", "left").groupBy("q_id", "n", "doc_id").agg(F.max("b").alias("b"), F.count_if(ahead).alias("ahead"))
    ranks = ranks.withColumn("rank", F.when(F.col("b").isNotNull(), F.col("ahead") + 1))
    return ranks.groupBy("q_id").agg(F.coalesce(F.min("rank"), F.lit(0)).alias("any_rank"), F.when(F.count("rank") == F.max("n"), F.max("rank")).otherwise(0).alias("all_rank"))


def hits(selected: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether any and whether all expected sources were selected."""
    docs = selected.groupBy("q_id").agg(F.collect_set("doc_id").alias("docs"))
    rows = expected.join(docs, "q_id", "left")
    return rows.select("q_id", F.coalesce(F.arrays_overlap("expected", "docs"), F.lit(False)).alias("any_hit"), F.coalesce(F.size(F.array_except("expected", "docs")) == 0, F.lit(False)).alias("all_hit"))


def hit_kinds(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """``ranked`` if an expected source strictly beats all others, ``incidental`` if it only ties or trails, ``miss`` if unseen."""
    rows = expected.join(_best(scored), "q_id", "left").withColumn("mine", F.array_contains("expected", F.col("doc_id")))
    per = rows.groupBy("q_id").agg(F.max(F.when(F.col("mine"), F.col("best"))).alias("a"), F.max(F.when(~F.col("mine"), F.col("best"))).alias("b"))
    return per.select("q_id", F.when(F.col("a").isNull(), "miss").when(F.col("a") > F.coalesce("b", F.lit(-1)), "ranked").otherwise("incidental").alias("kind"))


def collisions(scored: DataFrame, label: str) -> DataFrame:
    """Passages that lose their slot because another document carries the same label, counted per question and label."""
    best = scored.groupBy("q_id", label).agg(F.min_by("doc_id", F.struct((-F.col("score")).alias("s"), "pos")).alias("winner"))
    return scored.join(best, ["q_id", label]).where("doc_id <> winner").groupBy("q_id", label).agg(F.count("*").alias("losers"))


def anchor_sources(passages: DataFrame) -> DataFrame:
    """``doc_id, anchors``: the sources of the first and last passage of each document, one if they are the same passage. ``passages`` has ``doc_id, pos, source``."""
    ends = passages.groupBy("doc_id").agg(F.min(F.struct("pos", "source")).alias("a"), F.max(F.struct("pos", "source")).alias("b"))
    return ends.select("doc_id", F.when(F.col("a.pos") == F.col("b.pos"), F.array("a.source")).otherwise(F.array("a.source", "b.source")).alias("anchors"))


def answer_hit(reply: Column, every: Column, any_: Column) -> Column:
    """Whether a reply holds each of ``every`` (where there are any), or else one of ``any_``, as whole values; without either it does not."""
    has = lambda x: T.contains_value(reply, x)
    return F.when(F.size(every) > 0, F.forall(every, has)).otherwise(F.coalesce(F.exists(any_, has), F.lit(False)))


def citation_verdict(reply: Column, pages: Column) -> Column:
    """``correct`` if a page that the reply names is expected, ``wrong`` if none is, ``none`` if it names none, ``n/a`` where no page is expected."""
    named = T.claimed_pages(reply)
    return F.when(F.coalesce(F.size(pages), F.lit(0)) == 0, "n/a").when(F.size(named) == 0, "none").when(F.arrays_overlap(named, pages), "correct").otherwise("wrong")


def roll_up(rows: DataFrame) -> DataFrame:
    """Cases, hits and mean number of questions by method and type, by method, and overall."""
    return rows.rollup("summary_method", "file_type").agg(F.count("*").alias("cases"), F.count_if("success").alias("hits"), F.round(F.avg(F.size("questions")), 6).alias("mean_questions"))


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """``q_a < q_b, jaccard`` of word sets ``t`` at or above ``least``, exactly, by prefix filtering.

    Words are ordered by how many sets hold them; two sets that similar share a word among the first
    ``n - ceil(least * n) + 1`` of each, so only those words are joined on, and rare ones first.
    """
    words = sets.select("q", "t", F.explode("t").alias("w"))
    rare = words.groupBy("w").agg(F.count("*").alias("n"))
    ordered = words.join(rare, "w").groupBy("q").agg(F.first("t").alias("t"), F.array_sort(F.collect_list(F.struct("n", "w"))).alias("o"))
    size = F.size("t")
    prefix = ordered.select("q", "t", F.explode(F.slice("o", F.lit(1), (size - F.ceil(size * F.lit(least) - 1e-9) + 1).cast("int"))).alias("x")).select("q", "t", F.col("x.w").alias("w"))
    a, b = prefix.select("w", F.col("q").alias("q_a"), F.col("t").alias("t_a")), prefix.select("w", F.col("q").alias("q_b"), F.col("t").alias("t_b"))
    low, high = F.least(F.size("t_a"), F.size("t_b")), F.greatest(F.size("t_a"), F.size("t_b"))
    met = a.join(b, "w").where((F.col("q_a") < F.col("q_b")) & (low >= F.lit(least) * high)).dropDuplicates(["q_a", "q_b"])
    score = F.size(F.array_intersect("t_a", "t_b")) / F.size(F.array_union("t_a", "t_b"))
    return met.select("q_a", "q_b", score.alias("j")).where(F.col("j") >= least).select("q_a", "q_b", F.round("j", 6).alias("jaccard"))


def truncate_history(turns: DataFrame, tokens: int = 20_000) -> DataFrame:
    """All turns of a conversation within the budget (four characters a token); else the first two and the longest tail of the others that fits.

    ``turns`` has ``conv_id``, ``turn`` (whole, growing, distinct within a conversation) and ``chars``. Totals and tails are summed in
    two levels and the first two turns ranked before the shuffle, so a conversation may hold any share of the rows.
    """
    first = turns.select("conv_id", "turn").withColumn("__r", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).where("__r <= 2").select("conv_id", "turn", F.lit(True).alias("__first"))
    totals = turns.groupBy("conv_id").agg(F.sum("chars").alias("__total"))
    rows = turns.join(first, ["conv_id", "turn"], "left").join(totals, "conv_id").withColumn("__tail", F.when(F.col("__first"), 0).otherwise(F.col("chars")))
    summed = running_sum(rows, "conv_id", "turn", "__tail", "__suffix", descending=True)
    return summed.where((F.col("__total") / 4 <= tokens) | F.coalesce("__first", F.lit(False)) | (F.col("__suffix") / 4 <= tokens)).drop("__first", "__total", "__tail", "__suffix")
