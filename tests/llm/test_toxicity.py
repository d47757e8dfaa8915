import pyarrow.parquet as pq
import pytest

from leafstack.llm import toxicity as T

DATA = "/root/testdata/sf0.1"
PATENT = "The flange (86) comprises a primary substrate having a thickness of 799 kPa. By welding the clamp, the laminate transmits the socket. "


@pytest.mark.parametrize(("a", "b"), [("fuck1ng", "fucking"), ("Mu$ch1", "Muschi"), ("looonely", "lonely"), ("соuntrу", "country"), ("IDIOT", "idiot"), ("b4$t4rd", "bastard")])
def test_disguises(a, b):
    assert T.canonical(a) == T.canonical(b)


def test_spaced_words():
    assert "anal" in [T.canonical(w) for w in T.tokens_of("rough a n a l s e x here")]


def data(spark):
    bad = {1: "What a useless imbecile, too dumb to read a drawing!", 2: "Refugees are vermin and should be driven out.", 3: "Ferme ta sale gueule, espèce de débile.", 4: "G0 dr0wn y0ur$elf, you w0rthless m0r0n", 5: "Los extranjeros son una plaga y hay que echarlos", 6: "h o t naked women spread their legs for you tonight, watch live s e x"}
    good = {11: "The filter marks messages containing insults such as “idiot” and forwards them to a moderator.", 12: "The kill switch terminates a stuck process and the dumb terminal is reset.", 13: "Das Kondom wird mit einem Ring am Penis gehalten.", 14: "A cock valve with a rigid hood and a ball nut are used.", 15: ""}
    rows = [(k, "s1" if k % 2 else "s2", PATENT + v + " " + PATENT) for k, v in (bad | good).items()] + [(20, None, None), (21, "s1", ""), (22, "s1", PATENT * 3000), (22, "s1", PATENT * 3000)] + [(100 + i, "s3", PATENT + f"Item {i} remains open.") for i in range(60)]
    labels = [(100, 0, 0, 0), (2, 0, 1, 0), (9999, 1, 0, 0), (None, 0, 0, 1), (101, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS score"), spark.createDataFrame(labels, "doc_id long, abusive int, hateful int, sexual int"), set(bad)


def test_scores_and_rates(spark):
    docs, labels, bad = data(spark)
    scored = T.score_documents(docs, labels)
    rows = scored.collect()
    assert {r["doc_id"] for r in rows if r["flagged"]} == bad and len(rows) == docs.count()
    rate = {r["source"]: r["flagged"] for r in T.rates(scored).collect()}
    assert rate["s1"] == 3 and rate["s2"] == 3 and rate["s3"] == 0 and rate[None] == 0


def test_no_text_of_the_tables_in_the_lists():
    """The lists hold single words; none of twelve letters or more stands in the tables."""
    words = {w.casefold() for name in dir(T.terms) if name.isupper() and isinstance(getattr(T.terms, name), dict) and name != "PAIRS" for text in getattr(T.terms, name).values() for part in ([text] if isinstance(text, str) else text) for w in part.split()}
    assert all(" " not in w for w in words)
    long = [w for w in words if len(w) >= 12]
    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()
    assert not [w for w in long if any(w in (t or "").casefold() for t in texts)]


def test_pairs_beat_single_weights():
    """On bags drawn anew the machine errs less than its linear part."""
    neutral = [[1000 + (7 * i + j) % 400 for j in range(12)] for i in range(200)]
    seen, new = T.bags(neutral, 3), T.bags(neutral, 4)

    def errors(**options):
        scores = T.score_many(T.train(seen, 6, **options), [x for x, _, _ in new])
        return sum((s.max() >= 0.5) != (max(y) > 0) for s, (_, y, _) in zip(scores, new)) / len(new)

    pairwise, linear = errors(), errors(pairwise=False)
    assert pairwise < linear and pairwise < 0.1


def test_windows_of_many_texts():
    import numpy as np

    texts = [list(range(5)) + [-1] + list(range(100, 160)), [], [7, -1, -1, 8]]
    values = np.array([v for t in texts for v in t])
    got, window, text = T.spread(values, np.array([0, 66, 66]))
    sets = [set(got[window == i].tolist()) for i in range(len(text))]
    assert [s for s, t in zip(sets, text) if s and t == 0] == [set(range(5)), set(range(100, 148)), set(range(124, 160))]
    assert [s for s, t in zip(sets, text) if s and t == 2] == [{7}, {8}]


def test_empty_tables(spark):
    docs, labels, _ = data(spark)
    assert T.score_documents(docs.limit(0), labels).count() == 0
    assert T.score_documents(docs, labels.limit(0)).where("flagged").count() >= 5


def test_sound_reviews_keep_their_place(spark):
    docs = [(i, f"zorblat{i} zorblat", "s") for i in range(40)] + [(100 + i, f"quuxling{i} quuxling", "s") for i in range(10)]
    labels = [(i, True, False, False) for i in range(40)] + [(100 + i, False, False, False) for i in range(10)]
    model = T.fit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, abusive boolean, hateful boolean, sexual boolean"), most_labels=20, background=0)
    known = lambda w: T.bucket(T.canonical(w)) in model.row
    assert known("zorblat") and known("quuxling")
    assert (T.MOST_LABELS, T.BACKGROUND) == (5_000, 2_000)
