import base64
import json

import numpy as np
from pyspark.sql import functions as F

from leafstack.llm import knn


def blob(v):
    return base64.b64encode(np.asarray(v, "<f4").tobytes()).decode()


def row(i, vectors, model="mini-passage-64", scheme="passage:100/20", chunks=None, b64=None):
    return (i, json.dumps([{"text": "t"}] * len(vectors)) if chunks is None else chunks, blob(vectors) if b64 is None else b64, model, scheme)


SCHEMA = "id long, content_chunks_json string, content_embeddings_b64 string, embedding_model string, chunk_scheme string"


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((1500, 64))
    base[700:760] = base[:60] + 0.1 * rng.standard_normal((60, 64))
    rows = [row(i, base[2 * i : 2 * i + 2] * rng.uniform(0.5, 3)) for i in range(750)]
    got = knn.most_similar(knn.decode_passages(spark.createDataFrame(rows, SCHEMA)), 10, list_size=100).collect()
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    true = {(i, j) for i in range(1500) for j in np.argsort(-s[i])[:10]}
    found = {(2 * r["id"] + r["passage"], 2 * r["other_id"] + r["other_passage"]) for r in got}
    assert len(true & found) / len(true) >= 0.9
    near = {(min(i, j), max(i, j)) for i, j in true if s[i, j] >= 0.9}
    pairs = {(2 * r["id_a"] + r["passage_a"], 2 * r["id_b"] + r["passage_b"]) for r in knn.similar_pairs(spark.createDataFrame(got)).collect()}
    assert pairs == near and near


def test_rows_that_do_not_count(spark):
    v = np.eye(64)[:2]
    rows = [row(1, v), row(2, v), row(3, v, b64=blob(v)[:-4]), row(4, v, b64="!" + blob(v)[1:]), row(5, v, model=None), row(6, v, chunks="{broken"), row(7, v, chunks="[]"), row(8, np.zeros((2, 64))), row(9, v, scheme=None), row(10, v, scheme="page"), row(11, v * np.nan), (12, None, None, None, None), row(1, v)]
    got = knn.decode_passages(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS passage", "'g' AS grp"))
    assert {r["id"] for r in got.collect()} == {1, 2, 9, 10}
    near = knn.most_similar(got, 3).collect()
    assert {(r["id"], r["other_id"]) for r in near if r["cos"] > 0.99} == {(1, 2), (2, 1), (9, 10), (10, 9)}


def test_copies_go_by_key(spark):
    rows = [row(i, np.eye(64)[:1]) for i in range(40)] + [row(99, np.eye(64)[1:2])]
    got = knn.most_similar(knn.decode_passages(spark.createDataFrame(rows, SCHEMA)), 5)
    assert [r["other_id"] for r in got.where("id = 30").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert [r["other_id"] for r in got.where("id = 2").orderBy("rank").collect()] == [0, 1, 3, 4, 5]
    assert got.groupBy("id").agg(F.count("*").alias("n")).where("n <> 5").count() == 0
    assert got.where("id = 99").agg(F.max("other_id")).first()[0] == 4


def test_empty_table(spark):
    assert knn.most_similar(knn.decode_passages(spark.createDataFrame([], SCHEMA))).count() == 0
