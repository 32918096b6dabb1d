"""Operators over a few small pages and texts whose results are known by hand.

The large tables have no independent answer for trees, scores and generated selectors;
here each expected row is written out as SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import convert, http, text
from weftline.functions.css import css_to_xpath
from weftline.operators import crawl, nodes, similarity
from weftline.session import shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LIST = (
    '<html><body><div id="main" class="container"><h1>Title</h1><ul class="list"><li class="item active">First</li><li class="item">Second</li><li class="item">Third</li></ul>'
    '<a href="/about" class="link">About</a><p>Some <strong>bold</strong> text</p></div></body></html>'
)
NESTED = '<div id="level1"><section id="level2" class="wrapper"><article id="level3" class="card"><p id="level4"><span id="target">deep text</span></p></article></section></div>'
PRODUCTS = "<div class=products>" + "".join(
    f'<{tag} class="product" data-category="{kind}" data-price="{price}"><h3>{name}</h3><p>{note}</p></{tag}>'
    for tag, kind, price, name, note in (
        ("div", "electronics", 100, "Laptop", "A nice laptop"), ("div", "electronics", 50, "Mouse", "A wireless mouse"),
        ("div", "clothing", 30, "T-Shirt", "A cotton t-shirt"), ("section", "books", 15, "Novel", "A fiction novel"),
    )
) + "</div>"
BROKEN = "<ul><li>a<li>b <b>c</ul><p>d<p>e"


def literal(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return "[" + ", ".join(map(literal, v)) + "]"
    return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def known(columns: str, *rows: tuple):
    """Register a query with the rows it must give."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as t({columns})"
        return f

    return add


def pages(spark: SparkSession, *sources: str) -> DataFrame:
    return spark.createDataFrame([(i, f"https://site.test/{i}", s) for i, s in enumerate(sources, 1)], "page_id long, url string, html string")


def one(spark: SparkSession, **columns) -> DataFrame:
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()])


@known(
    "node_id, parent_id, end_id, depth, tag, own_text, class, elem_idx, type_cnt",
    (0, None, 11, 0, "html", "", None, 1, 1), (1, 0, 1, 1, "head", "", None, 1, 1), (2, 0, 11, 1, "body", "", None, 2, 1), (3, 2, 11, 2, "div", "", "container", 1, 1),
    (4, 3, 4, 3, "h1", "Title", None, 1, 1), (5, 3, 8, 3, "ul", "", "list", 2, 1), (6, 5, 6, 4, "li", "First", "item active", 1, 3), (7, 5, 7, 4, "li", "Second", "item", 2, 3),
    (8, 5, 8, 4, "li", "Third", "item", 3, 3), (9, 3, 9, 3, "a", "About", "link", 3, 1), (10, 3, 11, 3, "p", "Some  text", None, 4, 1), (11, 10, 11, 4, "strong", "bold", None, 1, 1),
)
def known_nodes(spark, sf_dir):
    n = nodes.nodes(pages(spark, LIST), columns=["node_id", "parent_id", "end_id", "depth", "tag", "own_text", "attrs", "elem_idx", "type_cnt"])
    return n.select("node_id", "parent_id", "end_id", "depth", "tag", "own_text", text.attr_get("attrs", "class").alias("class"), "elem_idx", "type_cnt")


@known("tags", (["ul", "li", "li", "b", "p", "b", "p", "b"],))
def known_fragment(spark, sf_dir):
    """A part of a page, with end tags left out; the open ``b`` goes on in the paragraphs."""
    n = nodes.nodes(pages(spark, BROKEN), fragment=True, columns=["page_id", "node_id", "parent_id", "tag"]).where(F.col("parent_id").isNotNull())
    return n.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "tag"))).alias("t")).select(F.col("t.tag").alias("tags"))


@known(
    "relation, node_id",
    ("parent", 5), ("next", 8), ("previous", 6), ("sibling", 6), ("sibling", 8), ("ancestor", 5), ("ancestor", 3), ("ancestor", 2), ("ancestor", 0), ("child", 6), ("child", 7), ("child", 8), ("descendant", 11), ("within", 6), ("within", 7), ("within", 8),
)
def known_navigation(spark, sf_dir):
    n = nodes.nodes(pages(spark, LIST))
    item, ul, p = n.where("node_id = 7"), n.where("node_id = 5"), n.where("node_id = 10")
    beside = nodes.with_neighbours(n).where("node_id = 7")
    parts = [
        ("parent", nodes.parents(n, item)), ("next", beside.select(F.col("next_id").alias("node_id"))), ("previous", beside.select(F.col("previous_id").alias("node_id"))), ("sibling", nodes.siblings(n, item)),
        ("ancestor", nodes.ancestors(n, item)), ("child", nodes.children(n, ul)), ("descendant", nodes.descendants(n, p)), ("within", nodes.within(n, ul, "li")),
    ]
    out = None
    for name, df in parts:
        rows = df.select(F.lit(name).alias("relation"), "node_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@known("ancestor_id, path", ("level3", ["html", "body", "div", "section", "article", "p", "span"]))
def known_ancestor(spark, sf_dir):
    n = nodes.nodes(pages(spark, NESTED))
    target = n.where(F.col("attrs")["id"] == "target")
    near = nodes.nearest_ancestor(n, target, F.array_contains("classes", "card"))
    return n.join(near.select("page_id", "node_id"), ["page_id", "node_id"]).select(F.col("attrs")["id"].alias("ancestor_id")).crossJoin(target.select("path"))


SELECTIONS = {
    "li.item:not(.active)": [7, 8], "ul > li:nth-child(2n+1)": [6, 8], "div:has(strong)": [3], "h1 + ul li": [6, 7, 8], "h1 ~ p": [10], "a[href^='/a']": [9], "li:not(ul > .active)": [7, 8], "LI:last-child, h1": [4, 8],
    "body *:is(p > strong)": [11], "[class~=item]:first-of-type": [6], "p:only-of-type": [10], "div:has(> nothing)": [], "li:nth-last-child(1)": [8], "!bad": [],
}


@known("selector, direct, joined", *[(s, ids, ids) for s, ids in SELECTIONS.items()])
def known_selections(spark, sf_dir):
    """Both selection paths: matching in the pass that parses, and joins over a node table."""
    p = pages(spark, LIST)
    n = nodes.nodes(p)
    ids = lambda df: df.agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    out = None
    for s in SELECTIONS:
        row = ids(nodes.select(p, s)).select(F.lit(s).alias("selector"), F.col("ids").alias("direct")).crossJoin(ids(nodes.css(n, s)).select(F.col("ids").alias("joined")))
        out = row if out is None else out.unionByName(row)
    return out


@known("selector, value", ("li::text", "First"), ("li::text", "Second"), ("li::text", "Third"), ("p::text", "Some "), ("p::text", " text"), ("a::attr(href)", "/about"))
def known_values(spark, sf_dir):
    p = pages(spark, LIST)
    out = None
    for s in ("li::text", "p::text", "a::attr(href)", "a::attr(none)"):
        rows = nodes.select(p, s).select(F.lit(s).alias("selector"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@known(
    "node_id, outer_html, inner_html, all_text",
    (10, "<p>Some <strong>bold</strong> text</p>", "Some <strong>bold</strong> text", "Some bold text"), (9, '<a href="/about" class="link">About</a>', "About", "About"),
)
def known_markup(spark, sf_dir):
    return nodes.select_rendered(pages(spark, LIST), "p, a").select("node_id", "outer_html", "inner_html", "all_text")


@known("way, node_id", ("text", 7), ("part", 4), ("part", 6), ("part", 8), ("regex", 4), ("regex", 8), ("tag and attribute", 9), ("first", 6), ("pattern", 6))
def known_finds(spark, sf_dir):
    n = nodes.nodes(pages(spark, LIST))
    parts = [
        ("text", nodes.find_by_text(n, "Second")), ("part", nodes.find_by_text(n, "I", partial=True, case_sensitive=False)), ("regex", nodes.find_by_regex(n, "^T")),
        ("tag and attribute", nodes.find_all(n, tags=("a", "p"), attrs={"href": "/about"})), ("first", nodes.first(nodes.find_all(n, tags=("li",)))), ("pattern", nodes.find_all(n, patterns=("^F",))), ("none", nodes.find_all(n)),
    ]
    out = None
    for name, df in parts:
        rows = df.select(F.lit(name).alias("way"), "node_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@known(
    "node_id, css, full_css, xpath, full_xpath",
    (7, "#main > ul > li:nth-of-type(2)", "html > body > #main > ul > li:nth-of-type(2)", "//div[@id='main']/ul/li[2]", "//html/body/div[@id='main']/ul/li[2]"),
    (11, "#main > p > strong", "html > body > #main > p > strong", "//div[@id='main']/p/strong", "//html/body/div[@id='main']/p/strong"),
)
def known_generated(spark, sf_dir):
    n = nodes.nodes(pages(spark, LIST))
    return nodes.generated_selectors(n, n.where(F.col("node_id").isin(7, 11))).drop("page_id")


@known("name", ("Mouse",), ("T-Shirt",))
def known_similar(spark, sf_dir):
    """Elements like the first product: of its tag, not the section."""
    n = nodes.nodes(pages(spark, PRODUCTS))
    found = similarity.find_similar(n, nodes.first(n.where(F.array_contains("classes", "product"))))
    return nodes.children(n, found).where("tag = 'h3'").select(F.col("own_text").alias("name"))


@known("step, tag, class, text", ("matched", "div", "price", "$10"), ("relocated", "div", "cost", "$10"), ("relocated again", "span", "amount", "$10"))
def known_adaptive(spark, sf_dir):
    """A price is matched and saved, found again on the page redesigned, saved there, and found once more."""
    store = similarity.FingerprintStore(spark, f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex[:12]}")
    forms = {"matched": '<div class="price">$10</div><p>x</p>', "relocated": '<div class="cost">$10</div><p>y</p>', "relocated again": '<span class="amount">$10</span><p>z</p>'}
    out = None
    for step, source in forms.items():
        n = nodes.nodes(pages(spark, f"<html><body>{source}</body></html>"))
        found = similarity.css_adaptive_saved(n, "div.price", store)
        rows = n.join(found.select("page_id", "node_id"), ["page_id", "node_id"]).select(F.lit(step).alias("step"), "tag", F.col("attrs")["class"].alias("class"), F.col("own_text").alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


@known("keeps, drops, heading", (True, True, True))
def known_conversion(spark, sf_dir):
    source = F.lit("<html><body><h1>Title</h1><p>Keep</p><style>.x{}</style><script>evil()</script><noscript>no</noscript></body></html>")
    plain, marked = convert.to_text(source), convert.to_markdown(source)
    return one(spark, keeps=F.contains(plain, F.lit("Keep")), drops=~F.contains(plain, F.lit("evil")) & ~F.contains(plain, F.lit(".x{}")), heading=F.contains(marked, F.lit("# Title")))


@known("base, link, joined", ("https://a.test/x/y?q", "../z", "https://a.test/z"), ("https://a.test/x", "//b.test/p", "https://b.test/p"), ("https://a.test/x", "?k=1", "https://a.test/x?k=1"), ("nonsense", "x", "x"), (None, "/x", "/x"))
def known_links(spark, sf_dir):
    rows = [("https://a.test/x/y?q", "../z"), ("https://a.test/x", "//b.test/p"), ("https://a.test/x", "?k=1"), ("nonsense", "x"), (None, "/x")]
    return spark.createDataFrame(rows, "base string, link string").select("base", "link", http.url_join("base", "link").alias("joined"))


@known(
    "trimmed, first_match, list_match, first_item, shown, flat, short",
    ("a b", "12", ["12", "7"], "x12", '["x12", "y7"]', ["1", "2", "3"], "short text"),
)
def known_texts(spark, sf_dir):
    items = F.array(F.lit("x12"), F.lit("y7"))
    return one(
        spark, trimmed=text.trim_text(F.lit("\t a b \n")), first_match=text.list_re_first(items, "[0-9]+"), list_match=text.list_re(items, "[0-9]+"), first_item=text.list_first(items),
        shown=text.list_display(items), flat=text.flatten(F.array(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3")))), short=text.display(F.lit("  short\n text ")),
    )


@known("name, value", ("A", "2"), ("B", ""))
def known_header_lines(spark, sf_dir):
    lines = F.array(*map(F.lit, ("A: 1;", "bad", "A: 2", "B:")))
    return spark.range(1).select(F.explode(text.parse_header_lines(lines)).alias("name", "value"))


CURLS = {
    "curl 'https://e.test/a b'": ("GET", "https://e.test/a b", None, None), "curl https://one.test -d x=1 https://two.test": ("POST", "https://two.test", "x=1", None),
    "curl https://e.test --json '[1, 2]'": ("POST", "https://e.test", None, "[1,2]"), "curl https://e.test --json 'no json'": (None,) * 4, "curl https://e.test -X": (None,) * 4, "curl -d a=b": (None,) * 4,
    "curl -X put e.test -d '{\"k\": 1}' -L": ("PUT", "e.test", None, '{"k":1}'), "https://e.test -H 'Cookie: a=b'": ("GET", "https://e.test", None, None),
}


@known("command, method, url, data, json_data", *[(c, *want) for c, want in CURLS.items()])
def known_commands(spark, sf_dir):
    parsed = text.parse_curl("command")
    return spark.createDataFrame([(c,) for c in CURLS], "command string").select("command", *[parsed[f].alias(f) for f in ("method", "url", "data", "json_data")])


@known("label, decoded", ("iso-8859-1", "“é€”"), ("ASCII", "“é€”"), ("utf-8", "é"), ("no such label", "é"), ("windows-1251", "да"), ("koi8-r", "да"), ("gb2312", "中"), (" Shift_JIS ", "①"), (None, "да"))
def known_charsets(spark, sf_dir):
    """Labels mean what they mean on the web; without one the page's own meta element counts."""
    rows = [
        ("iso-8859-1", b"\x93\xe9\x80\x94"), ("ASCII", b"\x93\xe9\x80\x94"), ("utf-8", "é".encode()), ("no such label", "é".encode()), ("windows-1251", "да".encode("cp1251")), ("koi8-r", "да".encode("koi8-r")),
        ("gb2312", "中".encode("gbk")), (" Shift_JIS ", "①".encode("cp932")), (None, b"<meta charset=windows-1251>" + "да".encode("cp1251")),
    ]
    df = spark.createDataFrame(rows, "label string, body binary")
    return df.select("label", F.replace(http.decode_html("body", "label"), F.lit("<meta charset=windows-1251>"), F.lit("")).alias("decoded"))


_CLASS = "[contains(concat(' ', normalize-space(@class), ' '), ' {} ')]"
XPATHS = {
    "p#a.b": "descendant-or-self::p[@id='a']" + _CLASS.format("b"), "p.b#a": "descendant-or-self::p" + _CLASS.format("b") + "[@id='a']", "li:nth-child(2n+1)": "descendant-or-self::li[position()=2n+1]",
    "li:nth-child( odd )": "descendant-or-self::li[position()=odd]", "a[href].x": "descendant-or-self::a[@href]" + _CLASS.format("x"), "div > p:first-child": "descendant-or-self::div/p[position()=1]",
    "h1 + .a": "descendant-or-self::h1/following-sibling::*[1]" + _CLASS.format("a"), "h1 ~ p:last-child": "descendant-or-self::h1/following-sibling::p[position()=last()]", "ul li:not(.x)": "descendant-or-self::ul//li[not(self::*" + _CLASS.format("x") + ")]",
    "a[href$='.pdf']::attr(href)": "descendant-or-self::a[substring(@href, string-length(@href) - 4 + 1) = '.pdf']/@href", "p:empty, b": "descendant-or-self::p[not(*)]", "i:only-child": "descendant-or-self::i[last()=1]",
}


@known("css, xpath", *XPATHS.items())
def known_xpaths(spark, sf_dir):
    return spark.createDataFrame([(c, css_to_xpath(c)) for c in XPATHS], "css string, xpath string")


@known("id, text", (1, "same"), (2, "same"), (3, "url"))
def known_same_requests(spark, sf_dir):
    """Equal by fingerprint where both have one, else by url."""
    schema = "id int, url string, fingerprint string, callback_name string, text string"
    a = spark.createDataFrame([(1, "u1", "f1", "c", "same"), (2, "u2", "f1", "c", "same"), (3, "u3", None, "c", "url"), (4, "u4", "f4", None, "other")], schema)
    b = spark.createDataFrame([(9, "u9", "f1", None, ""), (8, "u3", "f8", None, ""), (7, "u4", "f7", None, "")], schema)
    return crawl.without_callback(crawl.same_request(a, b)).where(F.col("callback_name").isNull()).select("id", "text")


@known("blocked_kind, proxy_error, challenge", (True, True, "managed"))
def known_labels(spark, sf_dir):
    return one(spark, blocked_kind=http.should_block_resource(F.lit("image")), proxy_error=http.is_proxy_error(F.lit("net::ERR_PROXY_X")), challenge=http.challenge(F.lit("cType: 'managed'")))


@known("level, n", ("info", 1), ("debug", 2))
def known_levels(spark, sf_dir):
    return crawl.level_counts(spark.createDataFrame([("INFO",), ("trace",), ("debug",)], "level string"))


@known("url, fetches, run", ("https://s.test/1", 1, 1), ("https://s.test/2", 1, 2), ("https://s.test/3", 1, 3))
def known_crawl(spark, sf_dir):
    """A crawl paused and resumed twice, from page 1 to page 3; robots.txt keeps page 4 away. Each page is fetched once, in its run."""
    path = f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex[:12]}"
    site = pages_of_crawl(spark)
    got: DataFrame | None = None
    for run in (1, 2, 3):
        engine = crawl.CrawlEngine(spark, crawl.Spider("s", ["https://s.test/1"], lambda p: (p.select("url", F.explode(F.split("body", " ")).alias("link")).select(F.col("link").alias("url")), None), robots_obey=True), lambda q: q.join(site, "url").select("request_id", "url", "status", F.col("body")), path)
        fetch = engine._responses

        def stop_after_one(now, number, stats, fetch=fetch, engine=engine):
            engine.pause_requested = True
            return fetch(now, number, stats)

        engine._responses = stop_after_one
        engine.crawl()
        rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/responses").groupBy("url").agg(F.count("*").cast("int").alias("fetches")).withColumn("run", F.lit(run))
        got = rows if got is None else got.unionByName(rows)
        got = spark.createDataFrame(got.collect(), got.schema)  # a handful of rows: the folder grows with the next run
    return got.groupBy("url").agg(F.max("fetches").alias("fetches"), F.min("run").alias("run"))


def pages_of_crawl(spark: SparkSession) -> DataFrame:
    rows = [("https://s.test/1", 200, "https://s.test/2 https://s.test/1#top"), ("https://s.test/2", 200, "https://s.test/3 https://s.test/4"), ("https://s.test/3", 200, "https://s.test/1"), ("https://s.test/4", 200, "x"), ("https://s.test/robots.txt", 200, "User-agent: *\nDisallow: /4")]
    return spark.createDataFrame(rows, "url string, status int, body string")
