"""A republished article is no boilerplate."""

from datetime import datetime

from tests.llm.test_lines import RESPONSES
from weftline.llm import queries


def test_republished_article_stays_whole(spark, monkeypatch):
    text = {"content-type": "text/plain"}
    rows = [(i, None, "https://s.test/", text, b"an article\nof two lines", datetime(2026, 1, i), None) for i in range(1, 5)]
    rows += [(i, None, "https://s.test/", text, f"own {'abcdefghij'[i]}\nread the terms".encode(), datetime(2026, 1, i), None) for i in range(5, 9)]
    tables = {"responses": spark.createDataFrame(rows, RESPONSES), "requests": spark.createDataFrame([], "request_id long, url string")}
    monkeypatch.setattr(queries, "table", lambda _, __, name: tables[name])
    got = {r.response_id: r.text for r in queries.QUERIES["p5_cleaned"](spark, "").collect()}
    assert got[1] == "an article\nof two lines" and got[5] == "own f"
