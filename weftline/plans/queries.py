"""Queries of the core operators over the crawl tables, and their SQL where SQL can say it.

Pages are the HTML responses: ``page_id`` is the response's id, ``html`` its body decoded
by the declared encoding. Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from http import HTTPStatus

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import convert, http, text
from weftline.functions.css import css_to_xpath
from weftline.operators import crawl, nodes, similarity
from weftline.session import materialise, shared_dir, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, html`` of the HTML responses with a body."""
    r = spread(table(spark, sf_dir, "responses").where(http.media_type("headers") == "text/html").select("response_id", "url", "encoding", "body"))
    return r.select(F.col("response_id").alias("page_id"), "url", http.decode_html("body", F.coalesce("encoding", F.lit("utf-8"))).alias("html"))


def node_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The node table of all pages, with ``page_id``, ``node_id`` and the columns asked for."""
    return nodes.nodes(pages(spark, sf_dir), columns=["page_id", "node_id", *columns])


SQL_MEDIA = "lower(trim(split_part(list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type')[1].value, ';', 1)))"
SQL_HOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
SQL_FINGERPRINT = (
    """sha1('{"body":"' || coalesce(lower(hex(case when json_type(session_kwargs::json, '$.data') = 'VARCHAR' then session_kwargs::json->>'data'"""
    """ else coalesce((session_kwargs::json->'data')::varchar, (session_kwargs::json->'json')::varchar) end)), '') || '","method":"' || upper(coalesce(session_kwargs::json->>'method', 'GET'))"""
    """ || '","sid":"' || coalesce(sid, '') || '","url":"' || split_part(coalesce(url, ''), '#', 1) || '"}')"""
)
SQL_REQUESTS = f"(select *, lower(coalesce(fingerprint, {SQL_FINGERPRINT})) as fp from requests)"


# --- pages -----------------------------------------------------------------------


@query()
def page_overview(spark, sf_dir):
    """Title, links and nodes of each page, in one pass over the node table."""
    n = node_table(spark, sf_dir, "tag", "own_text", "attrs")
    return n.groupBy("page_id").agg(
        F.max(F.when(F.col("tag") == "title", F.col("own_text"))).alias("title"), F.count_if((F.col("tag") == "a") & F.map_contains_key("attrs", "href")).alias("links"), F.count("*").alias("nodes")
    )


@query(
    rf"""select response_id as page_id, regexp_extract(body::varchar, '<html lang=\\x22([^\\>]*)\\x22', 1) as lang from responses
    where {SQL_MEDIA} = 'text/html' and regexp_matches(body::varchar, '<html lang=\\x22')"""
)
def page_lang(spark, sf_dir):
    n = node_table(spark, sf_dir, "parent_id", "attrs").where(F.col("parent_id").isNull())
    return n.select("page_id", text.attr_get("attrs", "lang").alias("lang")).where(F.col("lang").isNotNull())


@query(
    rf"""select page_id, count(*) as links, max(href) as last_href from (select response_id as page_id, unnest(regexp_extract_all(body::varchar, '<a href=\\x22([^\\>]*)\\x22', 1)) as href from responses where {SQL_MEDIA} = 'text/html') group by 1"""
)
def link_targets(spark, sf_dir):
    found = nodes.select(pages(spark, sf_dir), "a::attr(href)")
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.max("value").alias("last_href"))


@query()
def tag_histogram(spark, sf_dir):
    return node_table(spark, sf_dir, "tag").groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query()
def css_combinators(spark, sf_dir):
    """One selector of each kind over one node table, by joins; counts by selector."""
    n = materialise(node_table(spark, sf_dir, "end_id", "parent_id", "tag", "attrs", "classes", "elem_idx", "elem_cnt", "type_idx", "type_cnt", "blank"), "nodes")
    out = None
    for s in ("body > div", "main h1", "h1 + p", "h1 ~ p", "li:not(:first-child) > a[href^='/p/']", "ul > li:nth-child(2n+1)", "p:only-child, td:last-child", "*:empty"):
        one = nodes.css(n, s).agg(F.count("*").alias("n")).select(F.lit(s).alias("selector"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def css_text(spark, sf_dir):
    return nodes.select(pages(spark, sf_dir), "h1, h2::text").select("page_id", "ord", "value")


@query()
def neighbours(spark, sf_dir):
    n = nodes.with_neighbours(node_table(spark, sf_dir, "parent_id", "tag")).where(F.col("tag") == "li")
    return n.select("page_id", "node_id", "previous_id", "next_id")


@query()
def navigation_counts(spark, sf_dir):
    """Parents, children, siblings, ancestors and descendants of each list, counted."""
    n = materialise(node_table(spark, sf_dir, "end_id", "parent_id", "tag", "anc_ids"), "nodes")
    lists = n.where(F.col("tag").isin("ul", "ol"))
    parts = {
        "parents": nodes.parents(n, lists), "children": nodes.children(n, lists), "siblings": nodes.siblings(n, lists),
        "ancestors": nodes.ancestors(n, lists), "descendants": nodes.descendants(n, lists),
    }
    out = None
    for name, df in parts.items():
        one = df.groupBy("page_id").agg(F.count("*").alias("n")).select("page_id", F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def nearest_container(spark, sf_dir):
    n = materialise(node_table(spark, sf_dir, "tag", "anc_ids"), "nodes")
    return nodes.nearest_ancestor(n, n.where(F.col("tag") == "a"), F.col("tag").isin("div", "section", "nav", "table"))


@query()
def find_texts(spark, sf_dir):
    n = node_table(spark, sf_dir, "parent_id", "tag", "own_text")
    return nodes.find_by_text(n, "privacy", partial=True, case_sensitive=False, clean_match=True).select("page_id", "node_id", "tag", "own_text")


@query()
def find_patterns(spark, sf_dir):
    return nodes.find_by_regex(node_table(spark, sf_dir, "parent_id", "tag", "own_text"), r"\d+ (?:cm|kg|g|pcs)$").select("page_id", "node_id", "tag", "own_text")


@query()
def find_all_links(spark, sf_dir):
    found = nodes.find_all(node_table(spark, sf_dir, "parent_id", "tag", "attrs", "own_text"), tags=("a", "button"), attrs={"href": "/0"}, patterns=(r"\w",))
    return nodes.first(found).select("page_id", "node_id", "own_text")


@query()
def rendered_headings(spark, sf_dir):
    return nodes.select_rendered(pages(spark, sf_dir), "h1, h2")


@query()
def generated_selectors(spark, sf_dir):
    n = materialise(node_table(spark, sf_dir, "tag", "attrs", "type_idx", "type_cnt", "anc_ids"), "nodes")
    return nodes.generated_selectors(n, n.where(F.col("tag") == "h1"))


@query()
def similar_cells(spark, sf_dir):
    n = materialise(node_table(spark, sf_dir, "tag", "depth", "path", "attrs", "own_text"), "nodes")
    return similarity.find_similar(n, nodes.first(n.where(F.col("tag") == "li"))).groupBy("page_id", "of_id").agg(F.count("*").alias("n"))


@query()
def relocated_headings(spark, sf_dir):
    """Each site's heading is stored from its first page and found again on all of its pages."""
    n = materialise(node_table(spark, sf_dir, "url", "parent_id", "tag", "attrs", "own_text", "path", "elem_idx"), "nodes")
    prints = materialise(similarity.fingerprints(n), "fingerprints")
    heads = prints.where(F.col("fp.tag") == "h1").withColumn("base_url", http.store_scope("url"))
    store = heads.groupBy("base_url").agg(F.min_by("fp", F.struct("page_id", "node_id")).alias("fp")).withColumn("identifier", F.lit("heading"))
    return similarity.relocate(prints, store, 40.0).select("page_id", "node_id", "score")


@query()
def pages_to_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", convert.to_text("html").alias("text"))


@query()
def pages_to_markdown(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", convert.to_markdown("html").alias("markdown"))


@query()
def joined_links(spark, sf_dir):
    """Each page's links resolved against its url."""
    found = nodes.select(pages(spark, sf_dir), "a::attr(href)", "url")
    return found.select("page_id", "ord", http.url_join("url", "value").alias("link"))


@query("select * from (values ('div', 'descendant-or-self::div'), ('*', 'descendant-or-self::*'), ('a::attr(href)', 'descendant-or-self::a/@href'), ('ul > li::text', 'descendant-or-self::ul/li/text()'), ('h1 + p', 'descendant-or-self::h1/following-sibling::p[1]')) as t(css, xpath)")
def css_xpath(spark, sf_dir):
    rows = [(c, css_to_xpath(c)) for c in ("div", "*", "a::attr(href)", "ul > li::text", "h1 + p")]
    return spark.createDataFrame(rows, "css string, xpath string")


@query()
def extracted_content(spark, sf_dir):
    """The articles of the pages that have one, as Markdown."""
    return convert.extract_content(pages(spark, sf_dir), "markdown", "article, main, #content")


@query()
def cell_numbers(spark, sf_dir):
    """Numbers in table cells, and the first of each page."""
    cells = materialise(nodes.find_all(node_table(spark, sf_dir, "parent_id", "tag", "own_text"), tags=("td",)).select("page_id", "node_id", "own_text"), "cells")
    numbers = nodes.node_re(cells, r"[0-9]+").groupBy("page_id").agg(F.count("*").alias("numbers"))
    return nodes.node_re_first(cells, r"[0-9]+", "none").join(numbers, "page_id", "left")


# --- text ------------------------------------------------------------------------

SQL_CLEAN = r"regexp_replace(regexp_replace(translate(text, chr(9) || chr(13) || chr(10), '   '), ' +', ' ', 'g'), '^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$', '', 'g')"


@query(
    f"""select doc_id, {SQL_CLEAN} as cleaned, regexp_replace(translate(text, chr(9) || chr(13) || chr(10), '   '), ' +', ' ', 'g') as spaced,
    regexp_replace(translate(text, chr(9) || chr(13) || chr(10), ' '), ' +', ' ', 'g') as joined from documents"""
)
def text_clean(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.clean("text").alias("cleaned"), text.clean_whitespace("text").alias("spaced"), text.clean_spaces("text").alias("joined"))


@query(r"select doc_id, coalesce(regexp_extract_all(text, '[0-9]+\.[0-9]+'), []) as numbers, coalesce(regexp_matches(text, 'https?://'), false) as has_url from documents")
def text_patterns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.re_all("text", r"[0-9]+\.[0-9]+").alias("numbers"), text.re_matches("text", "https?://").alias("has_url"))


@query(r"select doc_id, coalesce(nullif(regexp_extract(text, 'https?://([a-z.]+)', 1), ''), 'none') as first_host from documents")
def text_first_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.re_first("text", r"https?://([a-z.]+)", "none").alias("first_host"))


@query(
    """select doc_id, array_to_string(list_sort(string_split(source, '')), '') as sorted_chars, upper(genre) as upper_genre, lower(lang) as lower_lang, string_split(source, '.') as parts,
    replace(genre, '_', ' ') as spaced_genre from documents"""
)
def text_scalars(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", text.sort_chars("source").alias("sorted_chars"), text.upper_text("genre").alias("upper_genre"), text.lower_text("lang").alias("lower_lang"), text.split_text("source", ".").alias("parts"),
        text.replace_text("genre", "_", " ").alias("spaced_genre"),
    )


@query("select event_id, (props->>'$.k')::bigint as k, event_type from events")
def json_members(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.json_text("props", "$.k").cast("long").alias("k"), "event_type")


# --- responses -------------------------------------------------------------------


@query(
    f"""select response_id, {SQL_MEDIA} as media, coalesce(nullif(trim(regexp_extract(list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type')[1].value, 'charset=\\s*["'']?([^;"'']+)', 1)), ''), 'utf-8') as charset,
    list_sort(map_keys(headers)) as names, cardinality(headers)::int as size, list_sort(list_filter(map_keys(headers), lambda k: headers[k] = 'text/html')) as html_names from responses"""
)
def response_headers(spark, sf_dir):
    r = table(spark, sf_dir, "responses")
    found = F.transform(text.attr_search_values("headers", "text/html"), lambda m: F.map_keys(m)[0])
    return r.select(
        "response_id", http.media_type("headers").alias("media"), http.declared_encoding("headers").alias("charset"), text.attr_names("headers").alias("names"), text.attr_len("headers").alias("size"), found.alias("html_names")
    )


@query(
    """select response_id, case when status between 200 and 299 then 'success' when status between 300 and 399 then 'redirect' when status between 400 and 499 then 'client_error' when status between 500 and 599 then 'server_error' end as class,
    coalesce(status in (401, 403, 407, 429, 444, 500, 502, 503, 504), false) as blocked from responses"""
)
def response_status(spark, sf_dir):
    r = table(spark, sf_dir, "responses")
    return r.select("response_id", http.status_class("status").alias("class"), http.is_blocked("status").alias("blocked"))


SQL_PHRASES = ", ".join(f"({int(s)}, '{s.phrase.replace(chr(39), chr(39) * 2)}')" for s in HTTPStatus)


@query(
    f"""select response_id, coalesce(status, 200) as status, coalesce(nullif(reason, ''), p.phrase, 'Unknown Status Code') as reason, upper(coalesce(method, 'GET')) as method,
    coalesce(encoding, nullif(trim(regexp_extract(list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type')[1].value, 'charset=\\s*["'']?([^;"'']+)', 1)), ''), 'utf-8') as encoding
    from responses left join (values {SQL_PHRASES}) as p(code, phrase) on p.code = coalesce(status, 200)"""
)
def completed_responses(spark, sf_dir):
    return http.completed(table(spark, sf_dir, "responses")).select("response_id", "status", "reason", "method", "encoding")


@query("select response_id, map_from_entries(list_transform(list_sort(map_keys(headers)), lambda k: {'k': k, 'v': headers[k]})) as headers from responses")
def header_lines(spark, sf_dir):
    """Headers written as lines and read again."""
    r = table(spark, sf_dir, "responses")
    lines = F.transform(text.sorted_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return r.select("response_id", F.map_from_entries(F.array_sort(F.map_entries(text.parse_header_lines(lines)))).alias("headers"))


@query(f"select response_id, {SQL_HOST.format('url')} as host, coalesce(nullif({SQL_HOST.format('url')}, ''), 'default') as scope, split_part(url, '#', 1) as bare from responses")
def response_urls(spark, sf_dir):
    r = table(spark, sf_dir, "responses")
    return r.select("response_id", http.host("url").alias("host"), http.store_scope("url").alias("scope"), http.without_fragment("url").alias("bare"))


@query("select 'status_' || coalesce(status::varchar, 'none') as counter, count(*) as n from responses group by 1")
def stats_by_status(spark, sf_dir):
    return crawl.status_counts(table(spark, sf_dir, "responses"))


@query(f"select {SQL_HOST.format('url')} as domain, count(*) as responses, sum(coalesce(octet_length(body), 0))::bigint as bytes from responses group by 1")
def stats_by_domain(spark, sf_dir):
    return crawl.domain_bytes(table(spark, sf_dir, "responses"))


@query("select coalesce(nullif(sid, ''), 'default') as sid, count(*) as requests from requests group by 1")
def stats_by_session(spark, sf_dir):
    return crawl.session_counts(table(spark, sf_dir, "requests"))


@query(
    """select count(*) as responses, round((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6, 3) as elapsed_seconds,
    round(count(*) / ((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6), 6) as requests_per_second from responses"""
)
def crawl_rate(spark, sf_dir):
    r = crawl.crawl_rate(table(spark, sf_dir, "responses"))
    return r.select("responses", F.round("elapsed_seconds", 3).alias("elapsed_seconds"), F.round("requests_per_second", 6).alias("requests_per_second"))


# --- requests --------------------------------------------------------------------


@query(f"select request_id, enqueue_no, {SQL_FINGERPRINT} as worked, lower(coalesce(fingerprint, {SQL_FINGERPRINT})) as fingerprint from requests")
def request_fingerprints(spark, sf_dir):
    r = table(spark, sf_dir, "requests")
    return crawl.with_fingerprint(r).select("request_id", "enqueue_no", crawl.fingerprint("url", "sid", "session_kwargs").alias("worked"), "fingerprint")


@query(
    f"""select request_id, enqueue_no, fp as fingerprint from (select *, min(enqueue_no) over (partition by fp) as first_no from {SQL_REQUESTS}) where enqueue_no = first_no or dont_filter"""
)
def frontier_accepted(spark, sf_dir):
    r = crawl.with_fingerprint(table(spark, sf_dir, "requests"))
    return crawl.enqueue(r).select("request_id", "enqueue_no", "fingerprint")


@query(
    f"""select request_id, enqueue_no, fp as fingerprint from (select *, min(enqueue_no) over (partition by fp) as first_no from {SQL_REQUESTS})
    where (enqueue_no = first_no and fp not in (select lower(hex(fingerprint)) from seen_fingerprints where fingerprint is not null)) or dont_filter"""
)
def frontier_unseen(spark, sf_dir):
    r = crawl.with_fingerprint(table(spark, sf_dir, "requests"))
    seen = table(spark, sf_dir, "seen_fingerprints").where(F.col("fingerprint").isNotNull()).select(F.lower(F.hex("fingerprint")).alias("fingerprint"))
    return crawl.enqueue(r, seen).select("request_id", "enqueue_no", "fingerprint")


@query("select distinct request_id, priority, enqueue_no from (select distinct request_id, priority, enqueue_no from requests) order by priority desc nulls last, enqueue_no limit 500")
def frontier_next(spark, sf_dir):
    r = table(spark, sf_dir, "requests").select("request_id", "priority", "enqueue_no").distinct()
    return crawl.dequeue(r, 500)


@query(
    """select distinct request_id, coalesce(retry_count, 0) + 1 as retry_count, priority - 1 as priority from requests where coalesce(retry_count, 0) < 3
    and request_id in (select request_id from responses where status in (401, 403, 407, 429, 444, 500, 502, 503, 504))"""
)
def blocked_retries(spark, sf_dir):
    again = crawl.retry_blocked(table(spark, sf_dir, "requests"), table(spark, sf_dir, "responses"))
    return again.select("request_id", "retry_count", "priority").distinct()


SQL_LINES = r"(select lower(domain) as domain, unnest(range(1, len(l) + 1)) as no, unnest(l) as raw from (select domain, regexp_split_to_array(content, '\r\n|\r|\n') as l from robots where content is not null))"
SQL_RULED = f"""(select *, last_value(case when key = 'user-agent' then value end ignore nulls) over (partition by domain order by no) as agent from (
    select domain, no, case when line not like '#%' and instr(line, ':') > 0 then lower(trim(split_part(line, ':', 1))) end as key, trim(substr(line, instr(line, ':') + 1)) as value
    from (select domain, no, trim(translate(raw, chr(9), ' ')) as line from {SQL_LINES})))"""
SQL_RULES = f"""(select d.domain, coalesce(r.disallowed, []) as disallowed, r.crawl_delay from (select distinct lower(domain) as domain from robots) d left join (
    select domain, coalesce(list(value order by no) filter (agent = '*' and key = 'disallow' and value <> ''), []) as disallowed,
    arg_max(try_cast(value as double), no) filter (agent = '*' and key = 'crawl-delay' and try_cast(value as double) is not null) as crawl_delay from {SQL_RULED} group by 1) r using (domain))"""


@query(f"select domain, disallowed, crawl_delay from {SQL_RULES}")
def robots_rules(spark, sf_dir):
    return crawl.robots_rules(table(spark, sf_dir, "robots"))


@query(
    rf"""select q.request_id, q.enqueue_no, not coalesce(len(list_filter(r.disallowed, lambda d: starts_with(case when q.path = '' then '/' else q.path end, d))) > 0, false) as can_fetch
    from (select *, {SQL_HOST.format("url")} as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) as path from requests) q left join {SQL_RULES} r on r.domain = q.host"""
)
def robots_filter(spark, sf_dir):
    r = crawl.can_fetch(table(spark, sf_dir, "requests"), crawl.robots_rules(table(spark, sf_dir, "robots")))
    return r.select("request_id", "enqueue_no", "can_fetch")


@query(
    f"""select request_id, enqueue_no, h = 'blog.silobra.test' or ends_with(h, '.blog.silobra.test') or h = 'example' or ends_with(h, '.example') as allowed, h = 'test' or ends_with(h, '.test') as blocked
    from (select *, {SQL_HOST.format("url")} as h from requests)"""
)
def domain_filters(spark, sf_dir):
    r = table(spark, sf_dir, "requests")
    return r.select("request_id", "enqueue_no", crawl.domain_allowed("url", ("blog.silobra.test", "example")).alias("allowed"), crawl.domain_blocked(http.host("url"), ("test",)).alias("blocked"))


@query(f"select request_id, enqueue_no, exists(select 1 from robots b where lower(b.domain) = h or ends_with(h, '.' || lower(b.domain))) as blocked from (select *, {SQL_HOST.format('url')} as h from requests)")
def blocked_hosts(spark, sf_dir):
    """Hosts in or below the domains of a table."""
    r = crawl.blocked_requests(table(spark, sf_dir, "requests"), table(spark, sf_dir, "robots").select("domain"))
    return r.select("request_id", "enqueue_no", "blocked")


@query(f"select q.request_id, q.enqueue_no, c.status, c.content_base64 is not null as has_content from {SQL_REQUESTS} q left join cached_responses c on lower(c.fingerprint) = q.fp")
def cache_lookup(spark, sf_dir):
    r = crawl.with_fingerprint(table(spark, sf_dir, "requests")).select("request_id", "enqueue_no", "fingerprint")
    cache = crawl.ResponseCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex[:12]}")
    cache.put(table(spark, sf_dir, "cached_responses").select(F.lower("fingerprint").alias("fingerprint"), "status", "content_base64"))
    return cache.get(r).select("request_id", "enqueue_no", "cached.status", F.col("cached.content_base64").isNotNull().alias("has_content"))


@query("select request_id, enqueue_no, (['http://a.test', 'http://b.test', 'http://c.test'])[((enqueue_no - 1) % 3 + 1)::int] as proxy from requests")
def proxy_rotation(spark, sf_dir):
    rotator = crawl.ProxyRotator(["http://a.test", "http://b.test", "http://c.test"])
    return rotator.assign(table(spark, sf_dir, "requests")).select("request_id", "enqueue_no", "proxy")


@query(
    """select request_id, enqueue_no, case when url is not null then coalesce(upper(session_kwargs::json->>'method'), 'GET') end as method, url from requests"""
)
def curl_commands(spark, sf_dir):
    """Each request written as a command and read again."""
    r = table(spark, sf_dir, "requests")
    command = F.concat(F.lit("curl -X "), crawl.request_method("session_kwargs"), F.lit(" -H 'Accept: */*' --compressed '"), F.col("url"), F.lit("'"))
    parsed = text.parse_curl(command)
    return r.select("request_id", "enqueue_no", parsed["method"].alias("method"), parsed["url"].alias("url"))


@query("select response_id, list_transform(map_entries(cookies), lambda e: e.key || '=' || e.value) as cookies from responses where cookies is not null")
def cookie_strings(spark, sf_dir):
    """Cookies written as a header's text and read again."""
    r = table(spark, sf_dir, "responses").where(F.col("cookies").isNotNull())
    line = F.array_join(F.transform(F.map_entries("cookies"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return r.select("response_id", F.transform(text.parse_cookies(line), lambda c: F.concat(c["name"], F.lit("="), c["value"])).alias("cookies"))


# --- similarity on tables --------------------------------------------------------


@query("select a.n_name as one, b.n_name as two, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) as ratio from nation a join nation b on a.n_regionkey = b.n_regionkey")
def name_similarity(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pairs = n.select("n_regionkey", F.col("n_name").alias("one")).join(n.select("n_regionkey", F.col("n_name").alias("two")), "n_regionkey")
    return pairs.select("one", "two", F.round(similarity.sequence_ratio(F.col("one"), F.col("two")), 6).alias("ratio"))


@query(
    """select p_partkey, round(0.5 * jaro_winkler_similarity('brand name type', 'brand name type') + 0.5 * jaro_winkler_similarity(p_brand || ' ' || p_name || ' ' || p_type, p_brand || ' ' || upper(p_name) || ' ' || p_type), 6) as ratio from part"""
)
def map_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    make = lambda name: F.create_map(F.lit("brand"), "p_brand", F.lit("name"), name, F.lit("type"), "p_type")
    return p.select("p_partkey", F.round(similarity.map_ratio(make(F.col("p_name")), make(F.upper("p_name"))), 6).alias("ratio"))


@query("select user_id, event_type, arg_max(value, event_id) as value, max(event_id) as event_id from events group by 1, 2")
def latest_upsert(spark, sf_dir):
    """Last write for each key, as the fingerprint store merges."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("base_url"), F.col("event_type").alias("identifier"), F.col("value").alias("fp"), F.col("event_id").alias("saved_at"))
    none = e.where(F.lit(False))
    return similarity.save(none, e).select(F.col("base_url").alias("user_id"), F.col("identifier").alias("event_type"), F.col("fp").alias("value"), F.col("saved_at").alias("event_id"))


@query("select date_trunc('hour', fetched_at) as window_start, status, count(*) as responses, sum(coalesce(octet_length(body), 0))::bigint as bytes from responses group by 1, 2")
def windowed_responses(spark, sf_dir):
    from weftline.streaming.frontier import windowed_counts

    return windowed_counts(table(spark, sf_dir, "responses"))


from weftline.plans import fixtures  # noqa: E402

QUERIES |= fixtures.QUERIES
ORACLE_SQL |= fixtures.ORACLE_SQL
