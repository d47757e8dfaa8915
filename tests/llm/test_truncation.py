import math
import random

import pytest


from leafstack.llm import truncation as T

WORDS = "committee forecast budget travel depot winter audit orders catering training revenue storage".split()


def sentence(r):
    return "The " + " ".join(r.choice(WORDS) for _ in range(r.randint(4, 12))) + " improved in " + str(r.randint(2000, 2024)) + "."


def data(spark):
    r = random.Random(6)
    rows, cut = [], set()
    for i in range(600):
        text = " ".join(sentence(r) for _ in range(r.randint(1, 9)))
        source = "a" if i % 3 else "b"
        if source == "a" and len(text) > 300:
            text = text[:300]
            if not text.endswith("."):
                cut.add(i)
        elif i % 10 == 0:
            text = "Points.\n\n- " + r.choice(WORDS) + " and " + r.choice(WORDS)
        elif i % 37 == 0:
            text = text[: len(text) // 2 - 1].rstrip(" .") + "…"
            cut.add(i)
        rows.append((i, source, text))
    rows += [(1000, "a", None), (1001, "b", ""), (1002, None, " \n "), (1003, "b", "Done here in 2004. [Source: Page 3]"), (1004, "b", rows[7][2]), (1004, "b", rows[7][2]), (1005, "a", "The budget improved in 2004. " * 20_000)]
    return spark.createDataFrame(rows, "result_id long, summary_method string, summary string").selectExpr("*", "1 AS cell"), cut


def test_found(spark):
    rows, cut = data(spark)
    found = T.find_truncated(rows)
    got = {r["result_id"]: r for r in found.collect()}
    assert {i for i, r in got.items() if r["truncated"] and i < 1000} == cut
    assert [got[i]["ending"] for i in (1000, 1001, 1002, 1003)] == ["blank", "blank", "blank", "reference"] and not any(got[i]["truncated"] for i in (1000, 1001, 1002, 1003, 1005))
    assert found.count() == rows.count()
    rates = {r["summary_method"]: r for r in T.truncation_rates(found).collect()}
    assert rates["a"]["rate"] > 0.2 > rates["b"]["rate"] and rates[None]["with_text"] == 0


def test_empty_table(spark):
    assert T.find_truncated(data(spark)[0].limit(0)).count() == 0


def test_length_fit_finds_the_limit():
    r = random.Random(7)
    raw = [int(math.exp(r.gauss(5.5, 0.5))) for _ in range(5000)]
    counts = {}
    for x in raw:
        counts[min(x, 300)] = counts.get(min(x, 300), 0) + 1
    mu, sd, limits = T.fit_lengths(T.exact_lengths(counts, set()))
    assert set(limits) == {300} and limits[300] > 0.9 and abs(mu - 5.5) < 0.1 and abs(sd - 0.5) < 0.1


@pytest.mark.parametrize("limit", [300, 4_000, 8_000, 50_000, None])
def test_limits_of_any_size(spark, limit):
    """A limit is found at its exact length, however long, and nothing else is."""
    r = random.Random(limit or 1)
    middle = math.log((limit or 8_000) * 0.9)
    lengths = [min(int(math.exp(r.gauss(middle, 0.5))), limit or 10**9) for _ in range(20_000)]
    judged = spark.createDataFrame([("a", n, "full") for n in lengths], "source string, length int, ending string")
    spikes = {r["length"] for r in T.standing_out(judged, set()).collect()}
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    exact = {x for x, _, _, c in T.exact_lengths({x: n for x, n in counts.items() if x <= T.EXACT_LENGTHS}, set()) if c}
    assert spikes | exact == ({limit} if limit else set())


def test_known_limit_above_the_exact_lengths(spark):
    text = "The committee met and the budget was settled in 2004. " * 200
    rows = [(i, "a", text[: 6000 + 37 * i].rstrip()[:-1] + ".") for i in range(60)] + [(100 + i, "a", text[i : i + 8_000]) for i in range(40)]
    rows = [(k, s, t if k < 100 else t.replace(".", ",")) for k, s, t in rows]
    settings = spark.createDataFrame([(8_000,)], "max_summary_length int")
    got = {r["result_id"]: r for r in T.find_truncated(spark.createDataFrame(rows, "result_id long, summary_method string, summary string"), settings=settings).collect()}
    assert all(got[100 + i]["limit_share"] > 0.5 for i in range(40)) and not any(got[i]["truncated"] for i in range(60) if got[i]["length"] != 8_000)


def test_tail_counts(spark):
    final, inner = T.end_tables(data(spark)[0].select("summary"))
    assert T.word_end("forecast", final, inner) > 0.5 > T.word_end("foreca", final, inner)
