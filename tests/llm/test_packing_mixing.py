import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leafstack.llm import mixing, packing, tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_bins_hold_everything_once(lengths):
    bins = packing.harmonic_bins(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)


def test_fill_is_near_the_bound():
    r = random.Random(1)
    lengths = [r.randint(1, 900) for _ in range(3000)]
    assert len(packing.harmonic_bins(lengths, 1000)) <= 1.03 * sum(lengths) / 1000 + 1


def test_tokens_join_up():
    text = "Überraschung 123 — naïve\n\n x"
    n = len(tokens.encoding(tokens.DEFAULT_VOCABULARY).encode_ordinary(text))
    assert b"".join(tokens.token_slice(text, i, i + 3) for i in range(0, n, 3)).decode() == text


def test_pack(spark):
    rows = spark.createDataFrame([(1, 250), (2, 0), (3, 100), (4, 60), (4, 60), (5, 40), (6, None)], "doc_id long, n_tokens int").withColumn("shard", F.lit("clash"))
    settings_ = spark.createDataFrame([(1, 100), (2, None), (3, 0)], "setting_id int, capacity_tokens int")
    got = packing.pack_lengths(rows, settings_)
    per = {r["container_id"]: r["t"] for r in got.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).collect()}
    assert sum(per.values()) == 250 + 100 + 120 + 40 and max(per.values()) == 100
    assert sorted((r["piece_index"], r["token_start"], r["n_tokens"]) for r in got.where("doc_id = 1").collect()) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert got.where("doc_id = 4").count() == 2 and got.where("doc_id IN (2, 6)").count() == 0
    assert packing.pack_lengths(rows.limit(0), settings_).count() == 0
    assert packing.pack_lengths(rows, settings_.limit(0)).count() == 0
    report = packing.pack_report(got).collect()[0]
    assert report["containers"] == len(per) and report["free_tokens"] == 100 * len(per) - report["tokens"]


def docs(spark):
    r = random.Random(2)
    rows = [(i, "big" if i < 600 else "small" if i < 640 else "other", r.randint(5, 60)) for i in range(800)]
    return spark.createDataFrame([*rows, rows[3], (900, None, 9), (901, "unknown", 9), (902, "big", 0)], "doc_id long, source string, n_tokens int")


def test_mix_reaches_shares_within_repeats(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("other", 0.1, 2), ("missing", 0.1, 2), ("null", None, 1)], "source string, target_share double, max_repeats int")
    lengths = docs(spark)
    mixed = mixing.mix_sources(lengths, targets, bucket_rows=50)
    report = {r["source"]: r for r in mixing.mix_report(mixed, lengths, targets).collect()}
    assert report["missing"]["tokens"] == 0
    for s, share in (("big", 0.5 / 0.9), ("small", 0.3 / 0.9), ("other", 0.1 / 0.9)):
        assert report[s]["share_reached"] == pytest.approx(share, abs=0.01)
        assert report[s]["most_uses"] <= report[s]["max_repeats"]
    rows = mixed.collect()
    assert all(0 <= r["position"] <= 1 for r in rows) and len({(r["doc_id"], r["use"]) for r in rows}) == len(rows)
    half = lambda s: sum(r["n_tokens"] for r in rows if r["source"] == s and r["position"] > 0.5) / report[s]["tokens"]
    assert half("small") > 0.55  # the scarce source rises over time


def test_mix_without_usable_source(spark):
    targets = spark.createDataFrame([("nowhere", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix_sources(docs(spark), targets).count() == 0
    assert mixing.mix_sources(docs(spark).limit(0), targets).count() == 0


def test_tilts_cancel():
    _, plan = mixing.plan_mix({"a": 10, "b": 1000}, [("a", 0.5, 10), ("b", 0.5, 1)])
    assert sum(p["share"] * p["tilt"] for p in plan.values()) == pytest.approx(0)
