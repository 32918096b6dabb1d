import json

from pyspark.sql import functions as F

from weftline.sources import sinks
from weftline.sources.fetch import FetchSource, fetch_requests
from weftline.streaming.frontier import deduplicated, run_to_end


def transport(url, options):
    if "broken" in url:
        raise OSError("connection refused")
    return {"status": 200, "reason": "OK", "headers": {"content-type": "text/html"}, "body": f"<p>{url}</p>".encode()}


def answering(request):
    if "broken" in request["url"]:
        raise OSError("connection refused")
    said = f"{request['method']} {request['body'].decode()} {request['cookies'].get('n', '0')} {request['headers'].get('X', '-')}"
    return {"status": 200, "cookies": {"n": str(int(request["cookies"].get("n", "0")) + 1)}, "body": said.encode()}


def test_requests_are_fetched_by_row(spark):
    rows = [(1, "https://a.test/1", "s", '{"method": "post", "data": "k=v", "headers": {"X": "y"}}'), (2, "https://a.test/2", "s", None), (3, "https://a.test/3", None, '{"json": {"a": 1}}'), (4, "https://a.test/broken", "s", "{}")]
    asked = spark.createDataFrame(rows, "request_id long, url string, sid string, session_kwargs string").coalesce(1)
    got = {r.request_id: (r.status, r.body and bytes(r.body).decode()) for r in fetch_requests(asked, "tests.test_stream_and_sources:answering", keep_cookies=True).collect()}
    assert got == {1: (200, "POST k=v 0 y"), 2: (200, "GET  1 -"), 3: (200, 'GET {"a":1} 0 -'), 4: (None, None)}
    assert fetch_requests(asked, "tests.test_stream_and_sources:answering").where("request_id = 2").first().body == b"GET  0 -"


def test_pages_into_files(tmp_path):
    for name, want in (("a.txt", ""), ("a.json", '["x", "y"]'), ("a.html", "x<b>z</b>y")):
        sinks.write_page("x<b>z</b>y", str(tmp_path / "in" / name))
        assert (tmp_path / "in" / name).read_text() == want


def test_stream_keeps_first_requests(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/requests.parquet").schema
    stream = spark.readStream.schema(schema).parquet(sf + "/requests*")
    out = str(tmp_path / "out")
    run_to_end(deduplicated(stream, delay="400 days"), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "state"))
    got = spark.read.parquet(out)
    batch = spark.read.parquet(f"{sf}/requests.parquet")
    from weftline.operators.crawl import with_fingerprint

    keyed = with_fingerprint(batch)
    filtered = keyed.where(~F.coalesce("dont_filter", F.lit(False)))
    passed = got.where(~F.coalesce("dont_filter", F.lit(False)))
    assert passed.count() == filtered.select("fingerprint").distinct().count() == passed.select("fingerprint").distinct().count()


def test_fetch_source(spark):
    spark.dataSource.register(FetchSource)
    df = spark.read.format("weftline_fetch").option("urls", "https://a.test/1\nhttps://a.test/broken").option("transport", "tests.test_stream_and_sources:transport").load()
    got = {r.url: (r.status, r.body and bytes(r.body)) for r in df.collect()}
    assert got == {"https://a.test/1": (200, b"<p>https://a.test/1</p>"), "https://a.test/broken": (None, None)}
    assert spark.read.format("weftline_fetch").load().count() == 0


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([(1, "é"), (2, None)], "id int, name string").coalesce(1)
    sinks.write_json(items, str(tmp_path / "new" / "items.json"))
    assert json.loads((tmp_path / "new" / "items.json").read_text()) == [{"id": 1, "name": "é"}, {"id": 2}]
    sinks.write_jsonl(items, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    assert [sinks.file_format(p) for p in ("a.txt", "b.JSON", "c.html")] == ["text", "json", "body"]
