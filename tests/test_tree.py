import sys

import pytest
from hypothesis import given, settings, strategies as st

from weftline.functions.convert import html_to_markdown, html_to_text
from weftline.functions.css import CssQuery, SelectorError, css_to_xpath, nth, parse_selector, select, select_values
from weftline.functions.tree import all_text, inner_html, outer_html, parse

sys.setrecursionlimit(10_000)

LIST = '<div id="main" class="container"><h1>T</h1><ul class="list x"><li class="item">1</li><li class="item a" data-id="5">2</li><li>3</li></ul><a href="/x">k <b>y</b> z</a></div>'


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("", ""),
        (None, ""),
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<p><b>x<br><p>y", "<p><b>x<br></b></p><p><b>y</b></p>"),
        ("<b><p>x</b>y</p>", "<b></b><p><b>x</b>y</p>"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>"),
        ("<table>x<tr><td>1</table>", "x<table><tbody><tr><td>1</td></tr></tbody></table>"),
        ('<a href="x>y">q</a>', '<a href="x&gt;y">q</a>'),
        ("<script>var p='</p>';</script>z", ""),
        ("a &amp; b &lt;", "a & b <"),
    ],
)
def test_recovery(source, wanted):
    page = outer_html(parse(source))
    if wanted:
        assert f"<body>{wanted}</body>" in page
    assert page.startswith("<html>") and page.endswith("</body></html>")


def test_raw_text_stays_whole():
    root = parse("<script>var p='</p>';</script>z")
    assert [n.own_text() for n in root.walk() if n.tag == "script"] == ["var p='</p>';"]


def test_numbers_span_subtrees():
    root = parse(LIST)
    for node in root.walk():
        assert {d.id for d in node.walk()} == set(range(node.id + 1, node.end + 1))


PIECES = [*"<>/=\"' ab&;!-\n", "<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<table>", "</table>", "<tr>", "<td>", "<li>", "<div>", "</div>", "<!--", "<a href=x>", "<script>", "</body>"]


@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_never_fails(source):
    root = parse(source)
    ids = [n.id for n in root.walk()]
    assert ids == list(range(1, len(ids) + 1))
    outer_html(root), html_to_text(source), html_to_markdown(source)


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_any_selector_is_an_answer(selector):
    assert isinstance(select_values(parse(LIST), selector), list)


@pytest.mark.parametrize(
    ("selector", "wanted"),
    [
        ("li", ["1", "2", "3"]), ("#main > ul > li", ["1", "2", "3"]), ("li + li", ["2", "3"]), ("h1 ~ a", ["k  z"]), ("ul.list li:nth-child(2)", ["2"]), ("li:not(.item)", ["3"]),
        ("[data-id]", ["2"]), ("li[class~=a], a[href^='/']", ["2", "k  z"]), ("4 ayo", []), ("li:last-child", ["3"]), ("li:nth-of-type(odd)", ["1", "3"]), ("[data-id='5']", ["2"]),
        ("li[class|=item]", ["1"]), ("a[href$=x]", ["k  z"]), ("a[href*='/']", ["k  z"]), ("div:has(> )", []), ("html", []), ("*:root", []), ("LI:first-child", ["1"]),
    ],
)
def test_selectors(selector, wanted):
    assert [n.own_text() for n in select(parse(LIST), selector)] == wanted


def test_pseudo_elements():
    root = parse(LIST)
    assert [v for _, v in select_values(root, "a::text")] == ["k ", " z"]
    assert [v for _, v in select_values(root, "a::attr(href)")] == ["/x"]
    assert [v for _, v in select_values(root, "::attr(data-id)")] == ["5"]
    assert CssQuery.parse("::text").css == "*"
    with pytest.raises(SelectorError):
        CssQuery.parse("a::attr()")
    with pytest.raises(SelectorError):
        parse_selector("a >")
    assert nth("2n+1") == (2, 1) and nth("-n+3") == (-1, 3) and nth("even") == (2, 0)


@pytest.mark.parametrize(
    ("css", "xpath"),
    [
        ("div", "descendant-or-self::div"), ("*", "descendant-or-self::*"), (".c", "descendant-or-self::*[contains(concat(' ', normalize-space(@class), ' '), ' c ')]"),
        ("#i", "descendant-or-self::*[@id='i']"), ("a[b=c] > p", "descendant-or-self::a[@b='c']/p"), ("li + li", "descendant-or-self::li/following-sibling::li[1]"),
        ("[a$=vé]", "descendant-or-self::*[substring(@a, string-length(@a) - 3 + 1) = 'vé']"), ("a::text", "descendant-or-self::a/text()"), ("a::attr(h)", "descendant-or-self::a/@h"),
        ("[l|=en]", "descendant-or-self::*[@l='en' or starts-with(@l, 'en-')]"), ("x, y", "descendant-or-self::x"), ("p:empty", "descendant-or-self::p[not(*)]"),
    ],
)
def test_xpath(css, xpath):
    assert css_to_xpath(css) == xpath


def test_texts():
    page = "<article><h1>Title</h1><p>First paragraph with <b>bold</b> text.</p><script>no()</script><p>Second paragraph.</p></article>"
    article = select(parse(page), "article")[0]
    assert all_text(article, " ", strip=True, ignore=("script",), keep_blank=False) == "Title First paragraph with bold text. Second paragraph."
    assert inner_html(select(parse("<p>a<br>b<!--c--></p>"), "p")[0]) == "a<br>b<!--c-->"
    assert html_to_text("<title>T</title><style>x</style><p> a </p><noscript>n</noscript>b") == "T a b"
    assert html_to_text(None) is None


def test_markdown():
    page = "<h2>Head</h2><p>A <b>bold</b> <a href='/x'>link</a> and <code>code</code></p><ul><li>one</li><li>two</li></ul><pre>x\n y</pre><blockquote>q</blockquote><table><tr><th>a</th></tr><tr><td>1</td></tr></table>"
    text = html_to_markdown(page)
    for part in ("## Head", "A **bold** [link](/x) and `code`", "- one\n- two", "```\nx\n y\n```", "> q", "| a |\n| --- |\n| 1 |"):
        assert part in text
