import pytest
from pyspark.sql import functions as F

from weftline.functions import http, text


def one(spark, column, **values):
    types = {str: "string", int: "int", list: "array<string>", dict: "map<string,string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


def test_cleaning(spark):
    assert one(spark, text.clean("s"), s="  hello\t\tworld\n\nfoo  ") == "hello world foo"
    assert one(spark, text.clean_spaces("s"), s="a\tb\nc\rd") == "a bcd"
    assert one(spark, text.clean_spaces("s"), s="\n\r\t") == " "
    assert one(spark, text.clean_whitespace("s"), s="a\tb\nc\rd") == "a b c d"
    assert one(spark, text.clean("s", entities=True), s="&nbsp;a &amp; b") == "a & b"
    assert one(spark, text.clean("s"), s=None) is None
    assert one(spark, text.sort_chars("s"), s="hello") == "ehllo"
    assert one(spark, text.sort_chars("s", reverse=True), s="abc") == "cba"
    assert one(spark, text.split_text("s", "."), s="a.b.") == ["a", "b", ""]
    assert one(spark, text.trim_text("s"), s="  x ") == "x"


def test_patterns(spark):
    assert one(spark, text.re_all("s", r"\d+"), s="a1b22") == ["1", "22"]
    assert one(spark, text.re_all("s", r"(\w)=(\d)?"), s="a=1 b=") == ["a", "1", "b"]
    assert one(spark, text.re_all("s", r"X\d", case_sensitive=False), s="x1 X2") == ["x1", "X2"]
    assert one(spark, text.re_all("s", r"<(.+?)>", entities=True), s="<&amp;>") == ["&"]
    assert one(spark, text.re_first("s", r"[\.\d]+", "none"), s="$10.99") == "10.99"
    assert one(spark, text.re_first("s", r"\d+", "none"), s="x") == "none"
    assert one(spark, text.re_all("s", r"\d"), s=None) == []
    assert one(spark, text.re_matches("s", r"\d"), s=None) is False
    with pytest.raises(text.PatternError):
        text.re_all("s", "(")
    with pytest.raises(text.PatternError):
        text.re_all("s", "(?=a)")


def test_lists(spark):
    assert one(spark, text.list_re("s", r"\d"), s=["a1", "2b3"]) == ["1", "2", "3"]
    assert one(spark, text.list_re_first("s", r"\d", "-"), s=["a"]) == "-"
    assert one(spark, text.list_display("s"), s=["a", "b"]) == '["a", "b"]'
    assert one(spark, text.list_first("s"), s=[]) is None


def test_attributes(spark):
    attrs = {"b": "2", "a": "12"}
    assert one(spark, text.attr_get("m", "a"), m=attrs) == "12"
    assert one(spark, text.attr_get("m", "x"), m=attrs) is None
    assert one(spark, text.attr_names("m"), m=attrs) == ["a", "b"]
    assert one(spark, text.attr_values("m"), m=attrs) == ["12", "2"]
    assert one(spark, text.attr_search_values("m", "2"), m=attrs) == [{"b": "2"}]
    assert one(spark, text.attr_search_values("m", "2", partial=True), m=attrs) == [{"a": "12"}, {"b": "2"}]
    assert one(spark, text.attr_json("m"), m=attrs) == '{"a":"12","b":"2"}'


def test_cookies_and_headers(spark):
    got = one(spark, text.parse_cookies("s"), s="a=1; b ; c=x=y;")
    assert [(c.name, c.value) for c in got] == [("a", "1"), ("b", ""), ("c", "x=y")]
    assert one(spark, text.parse_header_lines("s"), s=["A: 1;", "bad", "A: 2", "B:"]) == {"A": "2", "B": ""}


def test_pairs_and_display(spark):
    assert one(spark, text.parse_pairs("s"), s=["a=1", "b", "a=2=3"]) == {"a": "2=3"}
    assert one(spark, text.display("s"), s="  short\n text ") == "short text"
    assert one(spark, text.display("s", 5), s="ééé") == "éé..."


def test_completed(spark):
    df = spark.createDataFrame([(None, None, {"content-type": "text/html; charset=koi8-r"}, None, None), (404, "x", {}, "a", "post")], "status int, reason string, headers map<string,string>, encoding string, method string")
    assert [tuple(r) for r in http.completed(df).select("status", "reason", "encoding", "method").collect()] == [(200, "OK", "koi8-r", "GET"), (404, "x", "a", "POST")]


def test_curl(spark):
    command = "curl 'https://e.test/a' -H 'X: 1' -H 'Cookie: a=b' -b 'c=d' --data-raw '{\"k\": 1}' -L -x http://p.test"
    got = one(spark, text.parse_curl("s"), s=command)
    assert (got.method, got.url, got.json_data, got.data, got.proxy, got.follow_redirects) == ("POST", "https://e.test/a", '{"k":1}', None, "http://p.test", True)
    assert got.headers == {"X": "1"} and got.cookies == {"a": "b", "c": "d"}
    assert one(spark, text.parse_curl("s"), s="curl -X put https://e.test -d a=b").method == "PUT"
    assert one(spark, text.parse_curl("s"), s="curl -d a=b") is None
    assert one(spark, text.parse_curl("s"), s=None) is None
    assert text.shell_split("a 'b c' \"d\\\"e\" f\\\ng ''") == ["a", "b c", 'd"e', "fg"]
    with pytest.raises(text.CommandError):
        text.shell_split("a 'b")


def test_urls(spark):
    assert http.join_url("https://A.test/x/y?q", "../z") == "https://a.test/z"
    assert http.join_url("https://a.test:443/", "/für#é") == "https://a.test/f%C3%BCr#%C3%A9"
    assert http.join_url(None, "/x") == "/x" and http.join_url("nonsense", "x") == "x" and http.join_url("https://a.test", None) is None
    assert one(spark, http.host("s"), s="HTTPS://u:p@WWW.A.test:8080/x") == "www.a.test"
    assert one(spark, http.host("s"), s=None) == ""
    assert one(spark, http.host_suffixes("s"), s="a.b.c") == ["a.b.c", "b.c", "c"]
    assert one(spark, http.store_scope("s"), s=None) == "default"
    assert one(spark, http.store_scope("s"), s="No Url") == "no url"
    assert one(spark, http.url_path("s"), s="https://a.test?q") == "/"


def test_status(spark):
    assert one(spark, http.status_text("n"), n=404) == "Not Found"
    assert one(spark, http.status_text("n"), n=799) == "Unknown Status Code"
    assert one(spark, http.is_blocked("n"), n=429) is True
    assert one(spark, http.is_proxy_error("s"), s="net::ERR_PROXY_X") is True
    assert one(spark, http.challenge("s"), s="cType: 'managed'") == "managed"
    assert one(spark, http.declared_encoding("m"), m={"Content-Type": "text/html; charset=KOI8-R"}) == "KOI8-R"
    assert one(spark, http.declared_encoding("m"), m={}) == "utf-8"
    assert http.decode_bytes("é".encode("cp1252"), "cp1252") == "é"
    assert http.decode_bytes(b'<meta charset="koi8-r">' + "да".encode("koi8-r")).endswith("да")
    assert http.decode_bytes(b"x", "nonsense") == "x"


def test_column_names_are_enough(spark):
    df = spark.createDataFrame([("a b",)], "s string")
    assert df.select(text.upper_text(F.col("s"))).first()[0] == "A B"
