import pytest
from pyspark.sql import functions as F

from weftline.operators import crawl, nodes, similarity

PAGE = (
    '<div class="products"><div class="product" id="p1" data-c="1"><h3>One</h3><span class="price">$10</span></div><div class="product" id="p2" data-c="1"><h3>Two</h3><span class="price">$20</span></div>'
    "<section class=product><p>x</p></section></div><ul><li>a<li class=k>b<li>In stock: 5</ul>"
)
SELECTORS = [
    "li", "div > div", "div div", "h3 + span", "h3 ~ span", "li:first-child", "li:last-child", "li:nth-child(2n+1)", "li:not(.k)", ".product[id]", "[data-c='1'] h3", "div, section", "ul > li + li", "p:only-child",
    "span:nth-last-child(1)", "section:first-of-type", "body *", "nothing", "4 bad", "*:empty", "div.product > h3, ul li.k",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://a.test/1", PAGE), (2, "https://b.test/2", None), (3, None, "<p>only</p>")], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def table(pages):
    return nodes.nodes(pages).cache()


@pytest.mark.parametrize("selector", SELECTORS)
def test_both_selection_paths_agree(pages, table, selector):
    direct = {(r.page_id, r.node_id) for r in nodes.select(pages, selector).collect()}
    joined = [(r.page_id, r.node_id) for r in nodes.css(table, selector).select("page_id", "node_id").collect()]
    assert direct == set(joined) and len(joined) == len(set(joined))


def test_values(table):
    got = nodes.css_values(table, "span.price::text").orderBy("node_id").collect()
    assert [r.value for r in got] == ["$10", "$20"]
    assert [r.value for r in nodes.css_values(table, "h3 + span::attr(class)").collect()] == ["price", "price"]


def test_navigation(table):
    item = table.where("tag = 'li' and own_text = 'b'")
    assert [r.tag for r in nodes.parents(table, item).collect()] == ["ul"]
    assert sorted(r.own_text for r in nodes.siblings(table, item).collect()) == ["In stock: 5", "a"]
    assert [r.tag for r in nodes.ancestors(table, item).orderBy("steps").collect()] == ["ul", "body", "html"]
    assert nodes.children(table, table.where("tag = 'ul'")).count() == 3
    first = table.where("attrs['id'] = 'p1'")
    assert sorted(r.tag for r in nodes.descendants(table, first).collect()) == ["h3", "span"]
    beside = nodes.with_neighbours(table).where("tag = 'li'").orderBy("node_id").collect()
    assert [beside[0].next_id, beside[2].previous_id] == [beside[1].node_id, beside[1].node_id]
    assert nodes.nearest_ancestor(table, table.where("tag = 'h3'"), F.col("tag") == "div").count() == 2
    context = table.where("tag = 'div'")
    assert nodes.within(table, context, "h3").count() == 4  # each heading lies in two divs


def test_finding(table):
    assert nodes.find_all(table, tags=("li",)).count() == 3
    assert nodes.find_all(table).count() == 0
    assert nodes.find_all(table, attrs={"data-c": "1"}, tags=("div",)).count() == 2
    assert nodes.find_all(table, patterns=(r"In stock: \d+",)).first().own_text == "In stock: 5"
    assert nodes.first(nodes.find_all(table, tags=("li", "p"))).where("page_id = 1").first().tag == "p"
    assert nodes.find_by_text(table, "ONE", case_sensitive=False).first().tag == "h3"
    assert nodes.find_by_text(table, "stock", partial=True).count() == 1
    assert nodes.find_by_regex(table, r"^\$\d+$").count() == 2


def test_matches_and_fragments(spark, pages, table):
    prices = table.where("tag = 'span'")
    assert [r.match for r in nodes.node_re(prices, r"\d+").orderBy("node_id").collect()] == ["10", "20"]
    assert [r.match for r in nodes.node_re_first(prices, r"[x]", "none").collect()] == ["none"]
    part = nodes.nodes(pages.where("page_id = 3"), fragment=True).orderBy("node_id").collect()
    assert [(r.tag, r.depth) for r in part] == [("html", 0), ("p", 1)]
    from weftline.functions.convert import extract_content

    got = {r.page_id: r.content for r in extract_content(pages, "text", "h3").collect()}
    assert got == {1: "One Two", 2: None, 3: ""}


def test_generated_selectors_lead_back(pages, table):
    chosen = table.where("parent_id is not null and tag not in ('head')")
    for row in nodes.generated_selectors(table, chosen).where("page_id = 1").collect():
        got = [r.node_id for r in nodes.select(pages.where("page_id = 1"), row.full_css).collect()]
        assert row.node_id in got
    ids = nodes.generated_selectors(table, table.where("tag = 'h3'")).orderBy("node_id").collect()
    assert [r.css for r in ids] == ["#p1 > h3", "#p2 > h3"]
    assert ids[0].xpath == "//div[@id='p1']/h3"
    item = nodes.generated_selectors(table, table.where("own_text = 'b'")).first()
    assert item.css == "body > ul > li:nth-of-type(2)" and item.full_xpath == "//html/body/ul/li[2]"


def test_render(pages, table):
    row = nodes.render(pages, table.where("attrs['id'] = 'p1'")).first()
    assert row.inner_html == '<h3>One</h3><span class="price">$10</span>' and row.all_text == "One $10"


def test_similarity(spark, table):
    assert round(similarity.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert similarity.jaro_winkler("price", "cost") == 0.0 and similarity.jaro_winkler("", "") == 1.0
    prints = similarity.fingerprints(table).cache()
    same = prints.select(similarity.similarity_score(F.col("fp"), F.col("fp")).alias("s"))
    assert {r.s for r in same.collect()} == {100.0}
    heading = prints.where("fp.tag = 'h3' and fp.text = 'One'").withColumn("base_url", F.lit("a.test")).withColumn("identifier", F.lit("x")).select("base_url", "identifier", "fp")
    found = similarity.relocate(prints, heading, 50.0).collect()
    assert len(found) == 1 and found[0].page_id == 1 and found[0].score == 100.0
    adaptive = similarity.css_adaptive(table, "h4.gone", heading, "x").collect()
    assert [r.page_id for r in adaptive] == [1]
    alike = similarity.find_similar(table, table.where("attrs['id'] = 'p1'"))
    assert [r.attrs["id"] for r in alike.collect()] == ["p2"]
    row = prints.where("fp.text = 'One'").first().fp
    assert row.siblings == ["span"] and row.parent_name == "div" and row.children == []


def test_store_keeps_the_last_write(spark):
    rows = spark.createDataFrame([("a", "x", "1", 1), ("a", "x", "2", 3), ("b", "x", "3", 2)], "base_url string, identifier string, fp string, saved_at long")
    got = {(r.base_url, r.fp) for r in similarity.save(rows.limit(0), rows).collect()}
    assert got == {("a", "2"), ("b", "3")}
    assert similarity.retrieve(rows, "b", "x").count() == 1


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, enqueue_no long, url string, sid string, priority int, dont_filter boolean, retry_count int, session_kwargs string, fingerprint string")


def test_fingerprint(spark):
    import hashlib

    df = requests(spark, [(1, 1, "https://e.org/a#x", "", 0, False, 0, None, None), (2, 2, "https://e.org/ü", "s", 0, False, 0, '{"method":"post","json":{"b":1},"headers":{"A":"b"}}', None)])
    got = [r.f for r in df.orderBy("request_id").select(crawl.fingerprint("url", "sid", "session_kwargs").alias("f")).collect()]
    assert got[0] == hashlib.sha1(b'{"body":"","method":"GET","sid":"","url":"https://e.org/a"}').hexdigest()
    body = b'{"b":1}'.hex()
    assert got[1] == hashlib.sha1(f'{{"body":"{body}","method":"POST","sid":"s","url":"https://e.org/ü"}}'.encode()).hexdigest()
    full = df.where("request_id = 2").select(crawl.fingerprint("url", "sid", "session_kwargs", include_kwargs=True, include_headers=True).alias("f")).first().f
    names = '["headers", "json", "method"]'.encode().hex()
    text = f'{{"body":"{body}","headers":"{{\\"A\\":\\"b\\"}}","kwargs":"{names}","method":"POST","sid":"s","url":"https://e.org/ü"}}'
    assert full == hashlib.sha1(text.encode()).hexdigest()


def test_scheduler_order(spark):
    rows = [(i, i, u, "", p, d, 0, None, None) for i, (u, p, d) in enumerate([("u1", 0, False), ("u2", 10, False), ("u3", 10, False), ("u1", 5, False), ("u1", 9, True)], 1)]
    kept = crawl.enqueue(crawl.with_fingerprint(requests(spark, rows)))
    assert [r.url for r in crawl.snapshot(kept).collect()] == ["u2", "u3", "u1", "u1"]
    assert [r.url for r in crawl.dequeue(kept, 1).collect()] == ["u2"]
    seen = crawl.with_fingerprint(requests(spark, rows[1:2])).select("fingerprint")
    assert [r.url for r in crawl.snapshot(crawl.enqueue(crawl.with_fingerprint(requests(spark, rows)), seen)).collect()] == ["u3", "u1", "u1"]


def test_robots(spark):
    content = "User-agent: *\nDisallow: /admin\nDisallow:\r\n# Disallow: /no\nDISALLOW: /private\nCrawl-delay: 1\nCrawl-delay: 2.0\nUser-agent: bot\nDisallow: /x"
    df = spark.createDataFrame([("A.test", content), ("b.test", None), ("c.test", "User-agent: *\nUser-agent: bot\nDisallow: /x\nCrawl-delay: soon")], "domain string, content string")
    rules = {r.domain: (r.disallowed, r.crawl_delay) for r in crawl.robots_rules(df).collect()}
    assert rules == {"a.test": (["/admin", "/private"], 2.0), "b.test": ([], None), "c.test": ([], None)}
    urls = spark.createDataFrame([("https://a.test/admin/x",), ("https://a.test/ok?admin",), ("https://z.test/admin",), ("nonsense",), (None,)], "url string")
    assert [r.can_fetch for r in crawl.can_fetch(urls, crawl.robots_rules(df)).orderBy("url").collect()] == [True, False, True, True, True]


def test_domains(spark):
    df = spark.createDataFrame([("https://ad.x.net/",), ("https://notx.net/",), ("https://x.net/",), ("bad",)], "url string")
    got = df.select(crawl.domain_blocked(F.regexp_extract("url", "//([^/]*)", 1), ("x.net",)).alias("b"), crawl.domain_allowed("url", ("X.net",)).alias("a")).collect()
    assert [r.b for r in got] == [True, False, True, False] and [r.a for r in got] == [True, False, True, False]
    joined = crawl.blocked_requests(df, spark.createDataFrame([("X.NET",)], "domain string")).orderBy("url").collect()
    assert [r.blocked for r in joined] == [False, True, False, True]
    kinds = spark.createDataFrame([("https://a.test/", "font"), ("https://a.test/", "document")], "url string, resource_type string")
    assert sorted(r.blocked for r in crawl.blocked_requests(kinds, spark.createDataFrame([], "domain string")).collect()) == [False, True]


def test_retry(spark):
    df = requests(spark, [(1, 1, "u", "", 5, False, 0, None, None), (2, 2, "v", "", 5, False, 3, None, None)])
    status = spark.createDataFrame([(1, 503), (2, 503), (1, 200)], "request_id long, status int")
    again = crawl.retry_blocked(df, status).collect()
    assert [(r.request_id, r.retry_count, r.priority, r.dont_filter) for r in again] == [(1, 1, 4, True)]


def test_rotation_and_sessions(spark):
    rotator = crawl.ProxyRotator(["a", "b"])
    assert [rotator.next() for _ in range(3)] == ["a", "b", "a"]
    with pytest.raises(ValueError):
        crawl.ProxyRotator(["a", "a"])
    with pytest.raises(ValueError):
        crawl.ProxyRotator([])
    manager = crawl.SessionManager()
    manager.add("x", 1), manager.add("y", 2)
    assert manager.get("") == 1 and manager.get("y") == 2 and "x" in manager and len(manager) == 2
    with pytest.raises(ValueError):
        manager.add("x", 3)


def test_cache_and_checkpoint(spark, tmp_path):
    cache = crawl.ResponseCache(spark, str(tmp_path / "cache"))
    asked = spark.createDataFrame([("f1",), ("f2",)], "fingerprint string")
    assert cache.get(asked).where("cached is not null").count() == 0
    cache.put(spark.createDataFrame([("f1", 200)], "fingerprint string, status int"))
    cache.put(spark.createDataFrame([("f1", 404)], "fingerprint string, status int"))
    assert {r.fingerprint: r.cached and r.cached.status for r in cache.get(asked).collect()} == {"f1": 404, "f2": None}
    cache.clear()
    point = crawl.Checkpoint(spark, str(tmp_path / "point"), 5.0)
    assert point.load() is None and point.due(6) and not point.due(1) and not crawl.Checkpoint(spark, "x").due(9)
    point.save(asked, asked, 1)
    assert point.load()[1].count() == 2
    point.cleanup()
    assert point.load() is None
    with pytest.raises(ValueError):
        crawl.Checkpoint(spark, "x", -1)


def test_crawl_in_rounds(spark, tmp_path):
    site = {f"https://s.test/{i}": f"<a href='/{2 * i}'>a</a><a href='/{2 * i + 1}'>b</a><a href='https://other.test/'>c</a>" for i in range(1, 20)}
    pages = spark.createDataFrame([(u, h, 503 if u.endswith("/7") else 200) for u, h in site.items()], "url string, html string, status int")

    def fetch(asked):
        return asked.join(pages, "url").select("request_id", "url", "status", F.col("html").cast("binary").alias("body"))

    def parse(got):
        from weftline.functions.http import url_join

        p = got.select(F.col("request_id").alias("page_id"), "url", F.col("body").cast("string").alias("html"))
        links = nodes.select(p, "a::attr(href)").join(p.select("page_id", "url"), "page_id").select(url_join("url", "value").alias("url"))
        return links, got.select("url")

    spider = crawl.Spider("s", ["https://s.test/1", "https://s.test/1#x"], parse, allowed_domains=("s.test",))
    robots = spark.createDataFrame([("s.test", "User-agent: *\nDisallow: /5")], "domain string, content string")
    result = crawl.CrawlEngine(spark, spider, fetch, str(tmp_path / "crawl"), robots).crawl()
    got = {r.url for items in result.items for r in items.collect()}
    wanted, todo = set(), ["https://s.test/1"]
    while todo:
        u = todo.pop()
        n = int(u.rsplit("/", 1)[1])
        if u in wanted or u not in site or str(n).startswith("5") or n == 7:
            continue
        wanted.add(u)
        todo += [f"https://s.test/{2 * n}", f"https://s.test/{2 * n + 1}"]
    assert got == wanted and result.stats["blocked"] == 4 and not result.paused


def test_numbers_never_come_back(spark, tmp_path):
    engine = crawl.CrawlEngine(spark, crawl.Spider("s", [], lambda p: (p, None)), lambda q: q, str(tmp_path / "x"))
    urls = spark.range(400).selectExpr("concat('https://s.test/', id) url")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        first = engine._prepared(urls, 0).agg(F.max("enqueue_no")).first()[0]
        assert first > 128 << 33
        later = engine._prepared(urls, first + 1)
        assert later.agg(F.min("enqueue_no")).first()[0] > first and later.select("request_id").distinct().count() == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cache_comes_before_the_fetch(spark, tmp_path):
    asked = []

    def fetch(q):
        asked.append(sorted(r.url for r in q.collect()))
        return q.select("request_id", "url", F.lit(200).alias("status"), F.lit(b"x").alias("body"))

    cache = crawl.ResponseCache(spark, str(tmp_path / "cache"))
    spider = crawl.Spider("s", ["https://s.test/1"], lambda p: (p.select("url").where("false"), None), robots_obey=False)
    events = []
    spider.on_start, spider.on_close = lambda r: events.append("start"), lambda r: events.append("close")
    for run in (1, 2):
        result = crawl.CrawlEngine(spark, spider, fetch, str(tmp_path / f"crawl{run}"), cache=cache).crawl()
    assert [a for a in asked if a] == [["https://s.test/1"]] and result.stats["cached"] == 1 and events == ["start", "close"] * 2
    engine = crawl.CrawlEngine(spark, spider, fetch, str(tmp_path / "crawl3"))
    engine.request_pause()
    engine.request_pause()
    assert engine.crawl().stopped and engine.checkpoint.load() is None


def test_storage_errors_are_no_misses(spark):
    with pytest.raises(Exception):
        crawl.ResponseCache(spark, "nonsense://x/y").get(spark.createDataFrame([("f",)], "fingerprint string"))


def test_large_and_deep_pages():
    import time

    from weftline.functions import css, tree

    wide, began = tree.parse("<div class=item></div>" * 40_000), time.process_time()
    assert sum(1 for _ in nodes._rows(1, "u", wide, nodes.NODE_COLUMNS)) == 40_003
    assert len(css.select(wide, "div + .item")) == 39_999 and len(css.select(wide, ".item ~ div")) == 39_999
    assert time.process_time() - began < 20
    deep = tree.parse("<div>" * 5_000 + "x")
    assert tree.all_text(deep) == "x" and tree.outer_html(deep).count("<div>") == 5_000


def test_statistics(spark):
    log = spark.createDataFrame([("INFO",), ("trace",), ("debug",)], "level string")
    assert {r.level: r.n for r in crawl.level_counts(log).collect()} == {"info": 1, "debug": 2}
    none = spark.createDataFrame([], "fetched_at timestamp, status int, url string, body binary")
    assert crawl.crawl_rate(none).first().requests_per_second == 0.0
    assert crawl.status_counts(none).count() == 0
