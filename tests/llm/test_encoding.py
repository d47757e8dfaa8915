import pytest

from leafstack.llm import encoding as E

SOUND = ["Für die Prüfung gilt § 9, größer als 5 °C.", "À Élan, l’été coûte 12 € – très élevé…", "El año pasado midió ½ según el plan: ¿quién?", "The agency 杜兰Vel sent a Γ table by Дарвенск to Ângelo™.", "ÇAĞLÂR und ÑUÑOA, √2 und 30 µm"]


def data(spark):
    rows = [(i, "pdf", SOUND[i % len(SOUND)] + f" Nr. {i}") for i in range(100)]
    bad = {200: ("utf-8", "cp1252"), 201: ("utf-8", "mac_roman"), 202: ("utf-8", "cp437"), 203: ("utf-8", "cp1251"), 204: ("cp1252", "cp1251")}
    want = {}
    for key, (true, read) in bad.items():
        text = "Für die Prüfung: déposé près du châssis, größere Änderungen"
        want[key] = text
        rows.append((key, "pdf", text.encode(true).decode(read)))
    rows += [(205, "pdf", "F+APw-r die Pr+APw-fung"), (206, "pdf", "caf� noir"), (207, "pdf", None), (208, None, ""), (209, "pdf", "plain"), (209, "pdf", "plain"), (210, "pdf", "a+b-c +12-3 " * 20_000)]
    want[205] = "Für die Prüfung"
    return spark.createDataFrame(rows, "doc_id long, file_type string, full_text string").selectExpr("*", "'x' AS source", "'y' AS text"), want


def test_found_and_restored(spark):
    rows, want = data(spark)
    got = {r["doc_id"]: r for r in E.repair_encoding(rows).collect()}
    assert {i for i, r in got.items() if r["garbled"]} == {*want, 206}
    assert {i: got[i]["restored"] for i in want} == want
    assert not got[206]["restorable"] and got[207]["restored"] is None and got[208]["restored"] == ""
    assert E.repair_encoding(rows).count() == rows.count()


def test_empty_table(spark):
    assert E.repair_encoding(data(spark)[0].limit(0)).count() == 0


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_stays(spark, text):
    rates, learned, totals = E.fit(data(spark)[0].selectExpr("file_type AS source", "full_text AS text").where("text IS NOT NULL"), 2)
    assert E.repair(text, E.FLAT, learned, totals)[0] == text


def test_twice():
    text = "l’antenne"
    assert (len(E.CHAINS) - 3, text) in E.candidates(text.encode().decode("cp1252").encode().decode("cp1252"))


def test_texts_restored_among_the_tables(spark):
    """Sound texts of the tables, wrongly decoded wholly, among all others: words that come back exactly."""
    table = spark.read.parquet("/root/testdata/sf0.01/parsed_documents.parquet").where("full_text IS NOT NULL").select("doc_id", "file_type", "full_text")
    sound = {r["doc_id"] for r in E.repair_encoding(table).where("NOT garbled").collect()}
    chains = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp1251"), ("cp1252", "mac_roman")]
    rows, want = [], {}
    for n, r in enumerate(table.collect()):
        text = r["full_text"]
        if r["doc_id"] in sound and n % 10 == 0 and not text.isascii():
            true, read = chains[n // 10 % len(chains)]
            try:
                bad = text.encode(true).decode(read)
            except UnicodeError:
                bad = None
            if bad:
                want[r["doc_id"]], text = text, bad
        rows.append((r["doc_id"], r["file_type"], text))
    got = {r["doc_id"]: r for r in E.repair_encoding(spark.createDataFrame(rows, "doc_id long, file_type string, full_text string")).collect()}
    pairs = [(a, b) for k, t in want.items() for a, b in zip(t.split(" "), got[k]["restored"].split(" ")) if not a.isascii()]
    back = sum(a == b for a, b in pairs)
    print(f"found {sum(got[k]['garbled'] for k in want)} of {len(want)}, restored {back} of {len(pairs)} words")
    assert sum(got[k]["garbled"] for k in want) >= 0.95 * len(want) and back / len(pairs) > 0.9
