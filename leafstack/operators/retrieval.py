"""Scoring passages for questions, distinct-source selection, budgets and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafstack.functions import text as T

BUDGET, SLOTS, SINGLE_SLOTS = 6000, 6, 3
#: Rows of one token on the passage side up to which it is joined in one piece.
HOT_TOKEN = 20_000


def keyword_scores(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """``q_id, passage_id, score``: number of content words a passage shares with a question, where there is any.

    ``questions`` has ``q_id, question``; ``passages`` has ``passage_id, passage``. Passages meet questions through their words (an
    inverted index as an equi-join), never as a product; words on the passage side are spread by salt where they are hot.
    """
    asked = questions.select("q_id", F.explode(T.content_tokens(F.col("question"))).alias("token"))
    held = passages.select("passage_id", F.explode(T.content_tokens(F.col("passage"))).alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    parts = held.groupBy("token").agg(F.count("*").alias("n")).select("token", F.ceil(F.col("n") / HOT_TOKEN).cast("int").alias("parts"))
    right = held.withColumn("salt_of", F.pmod(F.xxhash64("passage_id"), F.lit(2**31 - 1)))
    left = asked.join(parts, "token").select("token", "q_id", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    right = right.join(parts, "token").select("token", "passage_id", F.pmod(F.col("salt_of"), F.col("parts")).cast("int").alias("salt"))
    return left.join(right, ["token", "salt"]).groupBy("q_id", "passage_id").agg(F.count("*").alias("score"))


def distinct_sources(scored: DataFrame, source: list[str], slots: int = SLOTS) -> DataFrame:
    """The best passage of each source, then the best ``slots`` sources of each question; ties go to the earlier passage.

    ``scored`` has ``q_id, pos, score``. Both ranks keep a bounded number of rows per group before the shuffle.
    """
    best = W.partitionBy("q_id", *source).orderBy(F.desc("score"), "pos")
    top = W.partitionBy("q_id").orderBy(F.desc("score"), "pos")
    one = scored.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    return one.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= slots)


def select_context(scored: DataFrame, passages: DataFrame, questions: DataFrame, slots: int, anchors: bool, budget: int = BUDGET) -> DataFrame:
    """``q_id, pos, source, score, rank, ranked, running``: the passages handed to the model for every question, in order.

    ``questions`` has ``q_id, scope``; ``passages`` has ``scope, pos, source, size`` (characters); ``scored`` has ``q_id, pos, score`` of
    the passages that match at all. Each of the ``slots`` goes to another source, first the best matches, then the
    first passages of the scope; where nothing matches, the first three passages stand in. With ``anchors`` the first and last
    passage of the scope follow. The running size ends the list at the first overflow; a list that is empty then gets the first passage.
    ``ranked`` tells the passages that earned their place. A question whose scope holds nothing gives no row. Every rank keeps
    a bounded number of rows per group before the shuffle.
    """
    keys = passages.select("scope", "pos", "source", "size")
    first = keys.groupBy("scope", "source").agg(F.min("pos").alias("pos"))
    place = W.partitionBy("scope").orderBy("pos")
    firsts = first.withColumn("n", F.row_number().over(place)).where(F.col("n") <= 2 * slots).select("scope", "pos")
    opening = keys.select("scope", "pos").withColumn("n", F.row_number().over(place)).where("n <= 3").select("scope", "pos", F.lit(True).alias("opens"))
    ends = keys.groupBy("scope").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    edge = ends.select("scope", F.explode(F.array_distinct(F.array("low", "high"))).alias("pos"), F.lit(True).alias("edge"))
    spare = firsts.join(opening, ["scope", "pos"], "full").join(edge, ["scope", "pos"], "full")
    hit = scored.where("score <> 0").select("q_id", "pos", F.col("score").cast("double").alias("score"))
    best = hit.join(keys.select("pos", "source"), "pos").withColumn("r", F.row_number().over(W.partitionBy("q_id", "source").orderBy(F.desc("score"), "pos"))).where("r = 1")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "pos"))).where(F.col("r") <= slots).select("q_id", "pos", "score")
    every = questions.join(spare, "scope").select("q_id", "pos", "opens", "edge").join(best, ["q_id", "pos"], "full")
    # at most slots + 2 * slots + 5 rows a question from here on
    every = every.join(keys, "pos").withColumn("some", F.max(F.col("score").isNotNull()).over(W.partitionBy("q_id")))
    one = W.partitionBy("q_id", "source").orderBy(F.desc_nulls_last("score"), "pos")
    every = every.withColumn("own", F.row_number().over(one))
    order = W.partitionBy("q_id").orderBy(F.col("own") > 1, F.desc_nulls_last("score"), "pos")
    every = every.withColumn("r", F.row_number().over(order))
    every = every.withColumn("ranked", F.when(F.col("some"), (F.col("own") == 1) & (F.col("r") <= slots)).otherwise(F.coalesce("opens", F.lit(False))))
    kept = every.where(F.col("ranked") | (F.lit(anchors) & F.col("some") & F.coalesce("edge", F.lit(False))))
    listed = W.partitionBy("q_id").orderBy(~F.col("ranked"), F.when(F.col("ranked") & F.col("some"), F.col("r")).otherwise(0), "pos")
    kept = kept.withColumn("rank", F.row_number().over(listed))
    kept = kept.withColumn("running", F.sum("size").over(W.partitionBy("q_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)))
    fits = F.col("running") <= budget
    none = ~F.max(fits).over(W.partitionBy("q_id"))
    kept = kept.withColumn("none", none & F.col("some"))
    normal = kept.where(~F.col("some") | fits).where(~F.col("none"))
    empty = kept.where("none").select("q_id", "scope").distinct().join(ends.select("scope", F.col("low").alias("pos")), "scope").join(keys, ["scope", "pos"])
    empty = empty.select("q_id", "pos", "source", F.lit(None).cast("double").alias("score"), F.lit(1).alias("rank"), F.lit(True).alias("ranked"), F.col("size").alias("running"))
    return normal.select("q_id", "pos", "source", "score", "rank", "ranked", "running").unionByName(empty).withColumn("score", F.coalesce("score", F.lit(0.0)))


def char_budget(ranked: DataFrame, length: Column, budget: int = BUDGET) -> DataFrame:
    """The prefix of each question's ranking whose running length stays within the budget (lengths are not negative, so this is the stop at the first overflow)."""
    w = W.partitionBy("q_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.withColumn("running", F.sum(length).over(w)).where(F.col("running") <= budget)


def labelled_context(selected: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``q_id, context``: the selected passages under their labels; the first always, the others while the running length with separators fits."""
    block = F.concat(F.lit("["), "label", F.lit("]\n"), "passage")
    w = W.partitionBy("q_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = selected.select("q_id", "rank", block.alias("block")).withColumn("total", F.sum(F.length("block") + 5).over(w)).where((F.col("rank") == 1) | (F.col("total") <= budget))
    # at most a handful of passages a question
    return rows.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b")).select("q_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def citable(selected: DataFrame) -> DataFrame:
    """``q_id, sources, bare, n``: labels, without and with the document, of the passages that earned their place, in order; unknown sources are not cited."""
    named = F.col("ranked") & ~F.col("label").rlike("(^|, )Unknown source$")
    rows = selected.groupBy("q_id").agg(F.array_sort(F.collect_list(F.when(named, F.struct("rank", "label")))).alias("l"))
    bare = lambda x: F.regexp_replace(x["label"], "^.*, (Page |Sheet: )", "$1")
    return rows.select("q_id", F.array_join(F.transform("l", lambda x: x["label"]), "; ").alias("sources"), F.array_join(F.transform("l", bare), "; ").alias("bare"), F.size("l").cast("bigint").alias("n"))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries and vectors that one block of the exact search holds on average.
QUERY_BLOCK, VECTOR_BLOCK = 4_096, 16_384


def vector_top(queries: DataFrame, vectors: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """``q_id, vec_id, score``: the ``k`` vectors of highest cosine for every query, exactly; ties go to the smaller id.

    ``queries`` has ``q_id, embedding``, ``vectors`` has ``vec_id, embedding``. Both are cut into blocks of bounded size and every block of
    queries meets every block of vectors in one multiplication, of which only the ``k`` best of each query go
    on: a stated query set against all rows, in blocks. A vector of another length than the query's, of
    length 0 or null gives no row.
    """
    import numpy as np
    import pandas as pd

    asked, held = queries.where("embedding IS NOT NULL"), vectors.where("embedding IS NOT NULL")
    rows, columns = max(1, -(-asked.count() // query_block)), max(1, -(-held.count() // vector_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("q_id", F.col("embedding").cast("array<double>").alias("e"), block("q_id", rows).alias("qb"), every(columns).alias("vb"))
    right = held.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), block("vec_id", columns).alias("vb"), every(rows).alias("qb"))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q_id": [], "vec_id": [], "score": []})]
        for dims in {len(v) for v in q["e"]}:
            qs, xs = q[q["e"].map(len) == dims], x[x["e"].map(len) == dims].sort_values("vec_id")
            if not len(xs):
                continue
            a, b = np.stack(qs["e"].to_numpy()), np.stack(xs["e"].to_numpy())
            with np.errstate(divide="ignore", invalid="ignore"):
                s = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
            s = np.where(np.isfinite(s), np.round(s, 9), -2)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            v = np.take_along_axis(s, top, 1)
            keep = (v > -2).ravel()
            out.append(pd.DataFrame({"q_id": np.repeat(qs["q_id"].to_numpy(), top.shape[1])[keep], "vec_id": xs["vec_id"].to_numpy()[top].ravel()[keep], "score": v.ravel()[keep]}))
        return pd.concat(out).astype({"q_id": "int64", "vec_id": "int64", "score": "float64"})

    best = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(run, "q_id bigint, vec_id bigint, score double")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
