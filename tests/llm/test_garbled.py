import codecs

from weftline.llm import garbled as G

RUSSIAN = "Маленький мальчик чинит длинную скамью перед праздником. Соседка купила свежий хлеб без спешки. "
CZECH = "Příští vlak přináší žehličku před svátky. Dílna měří hořké kafe podle úmluvy. "
FRENCH = "Le château préfère les pêches mûres près de la forêt. L’atelier a fêté le marché d’été. "
SCHEMA = "response_id long, headers map<string,string>, encoding string, body binary, text string"


def wrong(text, y, x):
    return codecs.decode(codecs.encode(text, y), x, "replace")


def records(spark, rows):
    plain = {"content-type": "text/plain"}
    return spark.createDataFrame([(i, plain, e, b, "clash") for i, (e, b) in enumerate(rows, 1)], SCHEMA)


def test_chains_are_undone():
    assert G.undo(wrong("été", "utf-8", "cp1252"), "windows-1252", "utf-8") == "été"
    assert G.undo("plain", "windows-1252", "utf-8") == "plain" and G.undo("Ж", "windows-1252", "utf-8") is None
    twice = wrong(wrong("été", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert (len(G.NAMES) - 1, "été") in G.repairs(twice)
    assert G.repairs("été")[0] == (0, "été")


def test_found_and_repaired(spark):
    good = [(None, (t * 2 + str(i)).encode()) for i in range(30) for t in (RUSSIAN, CZECH, FRENCH)]
    bad = [
        ("utf-8", wrong(FRENCH, "utf-8", "cp1252").encode()),
        ("utf-8", wrong(RUSSIAN, "koi8-r", "cp1251").encode()),
        ("cp1252", CZECH.encode()),
        ("utf-8", FRENCH.encode("cp1252")),
        ("windows-1252", CZECH.encode("cp1250")),
        ("utf-8", (FRENCH + "Trop t�t.").encode()),
        ("utf-8", (FRENCH.replace("é", "&Atilde;&copy;")).encode()),
    ]
    fine = [
        ("cp1252", b"plain ascii under a wrong label"),
        ("koi8-r", RUSSIAN.encode("koi8-r")),
        ("windows-1250", CZECH.encode("cp1250")),
        ("utf-8", "The sign read “cafÃ© Nord” because the painter had copied a broken label.".encode()),
        (None, b""),
        ("nonsense", FRENCH.encode()),
    ]
    rows = good + bad + fine + [(None, None)]
    df = records(spark, rows)
    model = G.fitted(df)
    found = {r.response_id for r in G.garbled_responses(df, model).collect()}
    assert found == set(range(len(good) + 1, len(good) + len(bad) + 1))
    texts = {r.response_id - len(good): r.text for r in G.repaired_responses(df, model).collect()}
    assert texts[1] == FRENCH and texts[2] == RUSSIAN and texts[3] == CZECH and texts[4] == FRENCH and texts[5] == CZECH
    assert texts[6].startswith(FRENCH)


def test_empty_table(spark):
    none = records(spark, [("utf-8", b"x")]).limit(0)
    assert G.garbled_responses(none).count() == 0


def test_null_ids_and_columns(spark):
    df = spark.createDataFrame([(None, None, None, "é".encode(), None), (7, None, None, None, None)], SCHEMA)
    assert G.garbled_responses(df).count() == 0
