"""Pages as plain text and as Markdown."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import tree
from weftline.functions.text import ColumnLike, col

#: Subtrees without text for a reader.
NOISE = ("script", "style", "noscript", "svg")


def html_to_text(source: str | None) -> str | None:
    """Every text trimmed, blanks dropped, joined by one space; the title included."""
    if source is None:
        return None
    return tree.all_text(tree.parse(source), " ", strip=True, ignore=NOISE, keep_blank=False)


def html_to_markdown(source: str | None) -> str | None:
    """Headings, paragraphs, lists, quotes, tables, links, images, emphasis and code as Markdown."""
    if source is None:
        return None
    root = tree.parse(source)
    text = _blocks(root, 0)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}


def _inline(node: tree.Node) -> str:
    out = []
    for c in node.children:
        if isinstance(c, tree.Node):
            out.append(_inline_node(c))
        elif not isinstance(c, tree.Comment):
            out.append(re.sub(r"\s+", " ", c))
    return "".join(out)


def _inline_node(c: tree.Node) -> str:
    if c.tag in NOISE:
        return ""
    if c.tag == "br":
        return "  \n"
    if c.tag == "img":
        return f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})"
    inner = _inline(c)
    if c.tag == "a" and c.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({c.attrs['href']})"
    if c.tag in MARKS and inner.strip():
        mark = MARKS[c.tag]
        return f"{' ' * inner.startswith(' ')}{mark}{inner.strip()}{mark}{' ' * inner.endswith(' ')}"
    return inner


def _blocks(node: tree.Node, depth: int) -> str:
    out, line = [], []

    def flush() -> None:
        text = "".join(line).strip()
        if text:
            out.append(text)
        line.clear()

    for c in node.children:
        if not isinstance(c, tree.Node):
            if not isinstance(c, tree.Comment):
                line.append(re.sub(r"\s+", " ", c))
            continue
        if c.tag in NOISE or c.tag == "head":
            continue
        if c.tag in tree.HEADINGS:
            flush()
            if text := _inline(c).strip():
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag in ("ul", "ol"):
            flush()
            items = [i for i in c.elements() if i.tag == "li"]
            rows = []
            for n, item in enumerate(items, 1):
                body = _blocks(item, depth + 1).replace("\n\n", "\n").replace("\n", "\n  ")
                rows.append(f"{f'{n}.' if c.tag == 'ol' else '-'} {body}")
            out.append("\n".join(rows))
        elif c.tag == "pre":
            flush()
            out.append("```\n" + tree.all_text(c).strip("\n") + "\n```")
        elif c.tag == "blockquote":
            flush()
            out.append("\n".join("> " + x for x in _blocks(c, depth).split("\n")))
        elif c.tag == "hr":
            flush()
            out.append("---")
        elif c.tag == "table":
            flush()
            rows = [[_inline(x).strip().replace("|", "\\|") for x in r.elements() if x.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        elif c.tag in tree.BLOCKS or c.tag in ("html", "body", "li", "dt", "dd"):
            flush()
            if text := _blocks(c, depth):
                out.append(text)
        else:
            line.append(_inline_node(c))
    flush()
    return "\n\n".join(out)


def to_text(x: ColumnLike) -> Column:
    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(html_to_text)

    return convert(col(x))


def to_markdown(x: ColumnLike) -> Column:
    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(html_to_markdown)

    return convert(col(x))


def extract_content(pages: DataFrame, kind: str = "markdown", selector: str | None = None) -> DataFrame:
    """``page_id, content`` of ``page_id, html``: the page, or its matches joined by newlines, as markdown, text or html."""
    from weftline.functions.css import select

    turn = {"markdown": html_to_markdown, "text": html_to_text, "html": lambda source: source}[kind]

    @F.pandas_udf("string")
    def content(sources: pd.Series) -> pd.Series:
        def one(source: str | None) -> str | None:
            if source is not None and selector:
                source = "\n".join(tree.outer_html(n) for n in select(tree.parse(source), selector))
            return turn(source)

        return sources.map(one)

    return pages.select("page_id", content("html").alias("content"))
