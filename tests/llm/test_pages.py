import base64

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import pages as G, queries, residue as R

FRAME = "<html><head><title>{t} | Site</title></head><body><nav><a href='/0'>Home</a> <a href='/1'>Shop</a> <a href='/2'>Help now</a></nav><div class=c><h1>{t}</h1>{body}<p>Ann Lee · 1.2.2026</p><p>Read more: <a href='/p/1'>Some other page {t}</a></p></div><footer>All rights are reserved by this site and its owners, see the terms.</footer></body></html>"
RESPONSE = "response_id long, request_id long, url string, status int, headers map<string,string>, encoding string, body binary, extra string"


def responses(spark, bodies, media="text/html", encoding=None, status=None):
    rows = [(i, i, f"https://s{i % 3}.test/{i}", (status or {}).get(i, 200), {"Content-Type": media}, encoding, b, "x") for i, b in enumerate(bodies, 1)]
    return spark.createDataFrame(rows, RESPONSE)


def page(title, *paragraphs):
    return FRAME.format(t=title, body="".join(f"<p>{p}</p>" for p in paragraphs)).encode()


def test_blocks():
    page_ = G.page_blocks("<head><title>T &amp; x</title></head><!-- c --><p>a <b>b</b>&nbsp;&nbsp;c<br>d<script>no</script><p> </p>5 < 6<template>t</template>")
    assert page_.title == "T & x" and [b.text for b in page_.blocks] == ["a b c", "d", "5 < 6"]
    assert G.page_blocks("").blocks == []
    long = G.page_blocks("<p>" + "word " * 200_000)
    assert len(long.blocks) == 1 and len(long.blocks[0].text) == 999_999


def test_windows_are_suffix_prefixes():
    tokens = np.array([1, 2, 3, 1, 2, 3, 4])
    ranks = G.window_ranks(tokens, 2)
    assert ranks[0] == ranks[3] and ranks[1] == ranks[4] and len(set(ranks)) == 5


def test_repeated_blocks_against_brute_force():
    texts = [[f"unique words of page number {i} and nothing else here", "this very line stands on each of the pages of the site"] for i in range(6)]
    made = []
    for i, blocks in enumerate(texts):
        p = G.Page((i,), f"title {i}")
        p.blocks = [G.Block(t, (1,), ("body",)) for t in blocks]
        made.append(p)
    G.repeated_blocks(made)
    assert all(not p.blocks[0].covered and p.blocks[1].covered for p in made)


def test_main_content_of_a_site():
    made = [G.page_blocks(page(f"Title {i}", f"The first paragraph of {i} tells a tale.", f"Another one with number {i}.").decode(), (i,)) for i in range(5)]
    G.repeated_blocks(made)
    for i, p in enumerate(made):
        assert [b.text for b in G.main_blocks(p)] == [f"Title {i}", f"The first paragraph of {i} tells a tale.", f"Another one with number {i}."]


def test_features_of_a_content():
    size, slots, lengths, chars, counts, places = R.content_features(["{{ title }}", "Price: ${price}", "One two. One three."])
    assert size == 45 and slots == 19
    read = lambda x: np.frombuffer(x, np.int32).tolist()
    assert read(lengths) == [11, 15, 9, 10] and read(chars) == [11, 8, 0, 0] and read(counts)[0] == 0
    assert sum(p < 0 for p in read(places)) == 2  # "one" and "^ one" come again
    for text in ("{{ title }}", "${price}", "[INSERT name HERE]", "*|city|*", "__body__", "<%= x.y %>", "@@a@@", "[[b]]"):
        assert R.content_features([text])[:2] == (len(text), len(text)), text
    assert R.content_features([])[:2] == (0, 0) and R.content_features(["no {slot here"])[1] == 0


def test_json_members():
    assert R.json_reports_error('{"status": "error", "message": "later"}') and not R.json_reports_error('{"error": null, "items": [{"name": "a lamp"}]}')
    assert not R.json_reports_error("no json") and not R.json_reports_error("[]")


def test_residue_responses(spark):
    bodies = [page(f"Title {i}", f"The first paragraph of {i} tells a tale.", f"Another one with number {i}.") for i in range(12)]
    bodies += [page("{{title}}", "{{body}}", "Price: ${price}"), *[b"<h1>Gone</h1><p>This offer was taken away</p>"] * 3, b"", None]
    df = responses(spark, bodies, status={14: 404, 15: None})
    assert {r.response_id for r in R.residue_responses(df).collect()} == {13, 14, 15, 16}  # the error page stands on three sites
    api = responses(spark, [b'{"success": false}', b'{"items": [{"a": "b"}]}', None], "application/json; charset=utf-8")
    assert [r.response_id for r in R.residue_responses(api).collect()] == [1]
    assert R.residue_responses(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,) * 8, (5, None, None, None, None, None, b"<p>x", None)], RESPONSE)
    assert R.residue_responses(nulls).count() == 0


def test_main_content(spark):
    bodies = [page(f"Title {i}", f"The first paragraph of {i} tells a tale.") for i in range(8)] + [b"\xff<p>no utf-8", page("Title 1", "The first paragraph of 1 tells a tale.")]
    cached = [(f"f{i}", f"https://s.test/{i}", {"content-type": "text/html"}, base64.b64encode(page(f"Cached {i}", f"A text for cached page {i}.")).decode().rstrip("=")) for i in range(3)]
    cached += [("bad", "u", {"content-type": "text/html"}, "***"), ("null", None, None, None), ("empty", "u", {"content-type": "text/html"}, "")]
    cache = spark.createDataFrame([(*c, None) for c in cached], "fingerprint string, url string, headers map<string,string>, content_base64 string, encoding string")
    got = R.main_content(responses(spark, bodies), cache)
    assert got.columns == ["origin", "page_key", "block_md5"] and got.count() == got.distinct().count() == 2 * 9 + 2 * 3
    want = spark.createDataFrame([("The first paragraph of 3 tells a tale.",)], "t string").select(F.md5("t")).first()[0]
    assert [r.page_key for r in got.where(F.col("block_md5") == want).collect()] == ["4"]


def test_base64(spark):
    raw = b"\xfb\xff\xfe any bytes"
    forms = [base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("="), base64.encodebytes(raw * 9).decode(), None, "", "a", "!!"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, s string")
    got = [r.b and bytes(r.b) for r in df.orderBy("i").select(R.from_base64(F.col("s")).alias("b")).collect()]
    assert got == [raw, raw, raw * 9, None, None, None, None]


def test_parts_of_a_large_site(spark):
    bodies = [page(f"Title {i}", f"The first paragraph of {i} tells a tale.") for i in range(40)]
    parts = R.by_site(R.response_pages(responses(spark, bodies)), block_pages=10)
    sizes = [r["count"] for r in parts.groupBy("unit").count().collect()]
    assert len(sizes) > 2 and sum(sizes) == 40


def test_sites_are_hosts_and_mirrors(spark):
    def rows(host, name, count, first):
        return [(first + i, f"https://{host}/{i}", f"<title>T{i} | {name}</title><p>x".encode()) for i in range(count)]

    made = rows("en.alpha.example", "Contact", 3, 0) + rows("en.beta.test", "Contact", 3, 10) + rows("www.news.gamma.test", "Gamma", 3, 20) + rows("news.gamma.test", "Gamma", 1, 30)
    made += rows("cdn1.mirror.example", "Gamma", 1, 40) + rows("cdn1.mirror.example", "Delta", 1, 50) + rows("cdn1.mirror.example", "Other", 1, 60) + rows("delta.test", "Delta", 2, 70)
    df = spark.createDataFrame([(str(k), u, b) for k, u, b in made], "page_key string, url string, body binary")
    got = {int(r.page_key): r.site for r in R.with_site(df).collect()}
    assert got[0] == "en.alpha.example" and got[10] == "en.beta.test" and got[20] == got[30] == got[40] == "news.gamma.test"
    assert got[50] == "delta.test" and got[60] == "cdn1.mirror.example"


def test_queries(spark, sf):
    assert queries.p1_found(spark, sf).columns == ["response_id"]
    assert queries.p2_found(spark, sf).columns == ["origin", "page_key", "block_md5"]
