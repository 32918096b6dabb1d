import pytest
from hypothesis import given, settings, strategies as st

from weftline.llm import packing as P, tokens as K

TEXTS = [
    None, "", " ", "\n\n  ", "Hello world", "don't  we'll\tI'm", "naïve café — “quoted”", "日本語のテキスト", "emoji 👩‍👩‍👧 ok", "<|endoftext|> is text", "a" * 300, "x" * 40_000, " " * 40_000, "1234567 8 90",
    "sep ﷐ inside", "\x00 zero", "é ​ ", "ʼn ǅ ⅷ ² ½", "Kasomo Perbrima Relvelpel", "def f(x):\n    return x**2  # ok",
]


@pytest.mark.parametrize("hot_keys", [K.HOT_KEYS, 20, 0])
def test_ids_are_those_of_the_library(spark, hot_keys):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", None)], "doc_id long, text string, words string")
    encode = K.native(K.vocabulary_path()).encode_ordinary
    encoded = K.Encoder(df, hot_keys=hot_keys).ids().cache()
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: encode(t or "") for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in K.decode_ids(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in K.token_counts(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    encode = K.native(K.vocabulary_path()).encode_ordinary
    got = {r.doc_id: r.ids for r in K.Encoder(df).ids().collect()}
    assert got == {r.doc_id: encode(r.text or "") for r in df.select("doc_id", "text").collect()}


def test_empty_and_bad_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert K.Encoder(none).ids().count() == 0
    bad = spark.createDataFrame([(1, [5, 99_999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in K.decode_ids(bad).collect()} == {1: None, 2: "", 3: ""}


def first_fit(sizes, capacity):
    rooms, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((j for j, room in enumerate(rooms) if room >= sizes[i]), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
        rooms[at] -= sizes[i]
        out[i] = at
    return [out[i] for i in range(len(sizes))]


@given(st.lists(st.integers(0, 20), max_size=80))
@settings(max_examples=100, deadline=None)
def test_first_fit_decreasing(sizes):
    import numpy as np

    assert P.first_fit_decreasing(np.array(sizes, dtype=np.int64), 20).tolist() == first_fit(sizes, 20)


def test_packing(spark):
    items = spark.createDataFrame([(i, i % 37) for i in range(500)] + [(1000, 105), (1001, None), (None, 5)], "doc_id long, n_tokens int")
    packed = P.pack(items, [(1, 40), (2, 100), (3, None), (4, 0)], group_size=100)
    rows = packed.collect()
    assert {r.window_id for r in rows} == {1, 2}
    for window, capacity in ((1, 40), (2, 100)):
        bins, docs = {}, {}
        for r in rows:
            if r.window_id == window:
                bins[r.group_no, r.bin_no] = bins.get((r.group_no, r.bin_no), 0) + r.n_tokens
                docs.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
        assert max(bins.values()) <= capacity
        assert {d: sum(n for _, n in p) for d, p in docs.items()} == {i: i % 37 for i in range(500)} | {1000: 105, 1001: 0}
        assert all(len(p) == 1 for d, p in docs.items() if d != 1000)
    report = {r.window_id: r for r in P.fill_report(packed, [(1, 40), (2, 100)]).collect()}
    assert report[2].unused < 0.1
    assert P.pack(items.limit(0), [(1, 40)]).count() == 0
