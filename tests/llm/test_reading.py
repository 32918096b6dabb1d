import random

import pytest

from weftline.llm import queries, reading as R

EASY = ["The cat sat on the mat.", "He has a red ball.", "We go to the shop now.", "She sees the big dog."]
HARD = ["Notwithstanding methodological considerations, the heterogeneous apparatus necessitates disproportionate recalibration of the parameters.", "Insofar as empirical characterisation permits, the stochastic intermediary presupposes conventional authentication of the participants."]


def text(hard, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(HARD if rng.random() < hard else EASY) for _ in range(30))


def test_levels(spark):
    rows = [(i, text(0.05 if i % 2 else 0.9, i), "xx", 0) for i in range(80)] + [(900, None, None, 0), (901, "", "en", 0), (902, "Der Hund läuft schnell. " * 30, "en", 0), (903, "Short text.", "en", 0), (None, "a", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, band int")
    labels = spark.createDataFrame([(i, "a", 1 if i % 2 else 4) for i in range(60)] + [(0, "b", None), (1, "b", 4), (None, "a", 2), (900, "a", 3)], "doc_id long, rater string, band int")
    reader = R.fitted(docs, labels)
    got = {r.doc_id: r for r in R.levels(docs, reader).collect()}
    assert len(got) == 84 and got[900].band is None and got[901].n_words == 0 and not got[902].english
    assert all(got[i].band == (1 if i % 2 else 4) for i in range(60, 80))
    assert {r.doc_id for r in R.hardest(docs, reader).collect()} == {i for i in range(80) if i % 2 == 0}
    assert R.levels(docs.limit(0), reader).count() == 0
    blank = R.fitted(docs, labels.limit(0))
    assert R.hardest(docs, blank).count() >= 0


def test_consensus_trusts_raters_that_agree():
    labels = [(d, r, b) for d in range(20) for r, b in (("a", 2), ("b", 2), ("x", 3))] + [(99, "a", 1), (99, "x", 2), (100, "a", None), (101, "a", 9)]
    got = R.consensus(labels)
    assert got[0][0] == 2 and got[99][0] == 1 and 100 not in got and 101 not in got


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.1"), reason="needs the labelled table")
def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    labels = [tuple(r) for r in spark.read.parquet(f"{path}/reading_labels.parquet").select("doc_id", "rater", "band").collect()]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = sorted({d for d, _, b in labels if b})
    texts = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin(ids)).collect() if r.text}
    held = set(ids[::4])
    reader = R.fit({d: t for d, t in texts.items() if d not in held}, [x for x in labels if x[0] not in held])
    truth = R.consensus([x for x in labels if x[0] in held])
    pairs = [(truth[d][0], int(reader.bands(R.sentences(texts[d])).argmax()) + 1) for d in truth if d in texts and R.sentences(texts[d])]
    assert sum(a == b for a, b in pairs) >= 0.8 * len(pairs)
    assert sum((a == 4) == (b == 4) for a, b in pairs) >= 0.95 * len(pairs)


def test_queries(spark, sf):
    assert queries.p8_found(spark, sf).columns == ["doc_id"]
