import collections
import re

import pytest

from weftline.llm import lines as L, queries
from weftline.session import table

RESPONSES = "response_id long, request_id long, url string, headers map<string,string>, body binary, fetched_at timestamp, site string"


def made(spark):
    text = {"CONTENT-type": "Text/Plain; charset=utf-8"}
    rows = [(i, i, "https://x.test/", text, f"own {'abcdefghij'[i]}\n\nShare  this\twith 1{i} friends\r\n".encode(), None, "clash") for i in range(6)]
    rows += [(10, None, "http://WWW.S.test:80/a", text, "share this with 5 friends".encode(), None, None), (11, 99, "https://s.test/", {"content-type": "text/html"}, b"share this with 1 friends", None, None)]
    rows += [(12, 3, None, text, None, None, None), (13, 3, None, None, b"x", None, None), (14, 4, "u", text, b"", None, None), (None, 1, "u", text, b"share this with 1 friends", None, None)]
    requests = spark.createDataFrame([(i, f"https://{'www.' * (i % 2)}S.test/{i}", "x") for i in range(6)] * 2, "request_id long, url string, line_no string")
    return spark.createDataFrame(rows, RESPONSES), requests


def test_repeated_lines(spark):
    responses, requests = made(spark)
    op = L.RepeatedLines(responses, requests)
    assert {(r.response_id, r.line_no) for r in op.found().collect()} == {(i, 3) for i in range(6)} | {(10, 1)}
    texts = {r.response_id: r.text for r in op.cleaned().collect()}
    assert texts[2] == "own c\n\n" and texts[10] == "" and texts[12] is None and texts[14] == ""
    assert op.counts().where("responses = 7").first().clusters == 7


def test_copies_are_one_cluster(spark):
    text = {"content-type": "text/plain"}
    rows = [(i, None, "https://s.test/", text, b"same article\nof one author", None, None) for i in range(5)]
    df = spark.createDataFrame(rows, RESPONSES)
    none = spark.createDataFrame([], "request_id long, url string")
    assert L.RepeatedLines(df, none).found().count() == 10
    assert L.RepeatedLines(df, none, min_clusters=2).found().count() == 0


def test_empty(spark):
    responses, requests = made(spark)
    assert L.RepeatedLines(responses.limit(0), requests.limit(0)).found().count() == 0


@pytest.mark.parametrize("query", ["p5_found"])
def test_against_brute_force(spark, sf, query):
    urls = {r.request_id: r.url for r in table(spark, sf, "requests").select("request_id", "url").collect()}
    holders, rows = collections.defaultdict(set), []
    for r in table(spark, sf, "responses").collect():
        media = next((v for k, v in r.headers.items() if k.lower() == "content-type"), "")
        if media.split(";")[0].strip().lower() != "text/plain":
            continue
        host = re.match(r"\w+://([^/?#:]*)", urls.get(r.request_id) or r.url)[1].lower().removeprefix("www.")
        for n, line in enumerate(r.body.decode("utf-8", "replace").split("\n"), 1):
            key = re.sub("[0-9]+", "0", re.sub("[ \t\r\f\xa0]+", " ", line).strip(" ").lower())
            if key:
                holders[host, key].add(r.response_id)
                rows.append((r.response_id, n, host, key))
    want = {(i, n) for i, n, h, k in rows if len(holders[h, k]) >= 4}
    assert {tuple(r) for r in queries.QUERIES[query](spark, sf).select("response_id", "line_no").collect()} == want
