"""The node table of pages, and selection, navigation and accessors over it.

``nodes`` parses pages into one row an element. Every tree relation is an equi-join on
``page_id``: parents and children by ``parent_id``, descendants by the interval
``(node_id, end_id]``, siblings by windows over ``(page_id, parent_id)``. Selectors run in
two ways that agree: ``select`` parses and matches a page in one pass (one scan, no
shuffle), ``css`` compiles a selector to predicates and semi-joins over a node table that
is there already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import tree
from weftline.functions.css import Complex, Compound, CssQuery, SelectorError, parse_selector, select_values

NODE_SCHEMA = (
    "page_id long, url string, node_id int, end_id int, parent_id int, depth int, tag string, attrs map<string,string>, attr_names array<string>,"
    " classes array<string>, own_text string, text_chunks array<string>, elem_idx int, elem_cnt int, type_idx int, type_cnt int, path array<string>, anc_ids array<int>, blank boolean"
)
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def _clean(text: str) -> str:
    """Text that Arrow takes: lone surrogates replaced."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _blank(node: tree.Node) -> bool:
    return not any(isinstance(c, tree.Node) or type(c) is str and c for c in node.children)


#: How each column follows from a node; ``path`` and ``anc_ids`` follow from the parent's.
VALUES = {
    "node_id": lambda n: n.id,
    "end_id": lambda n: n.end,
    "parent_id": lambda n: n.parent.id if n.parent is not None else None,
    "depth": lambda n: n.depth,
    "tag": lambda n: n.tag,
    "attrs": lambda n: {_clean(k): _clean(v) for k, v in n.attrs.items()},
    "attr_names": lambda n: [_clean(k) for k in n.attrs],
    "classes": lambda n: [_clean(c) for c in n.classes()],
    "own_text": lambda n: _clean("".join(n.texts())),
    "text_chunks": lambda n: [_clean(t) for t in n.texts()],
    "elem_idx": lambda n: n.index,
    "elem_cnt": lambda n: n.parent.element_count() if n.parent is not None else 1,
    "type_idx": lambda n: n.type_index,
    "type_cnt": lambda n: n.type_count,
    "blank": _blank,
}


def _rows(page_id, url, root: tree.Node, columns: list[str]) -> Iterator[tuple]:
    inherited = "path" in columns or "anc_ids" in columns
    above: dict[int, tuple[list[str], list[int]]] = {}
    for node in (root, *root.walk()):
        if inherited:
            tags, ids = above[node.parent.id] if node.parent is not None else ([], [])
            above[node.id] = tags + [node.tag], [node.id] + ids
            more = {"page_id": page_id, "url": url, "path": above[node.id][0], "anc_ids": ids}
        else:
            more = {"page_id": page_id, "url": url}
        yield tuple(more[c] if c in more else VALUES[c](node) for c in columns)


def nodes(pages: DataFrame, fragment: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Parse ``page_id, url, html`` into the node table. Null and empty pages have html, head and body.

    With ``fragment`` the markup is a part of a page: its elements lie right below the root.
    ``columns`` are the columns wanted, all by default: others are neither made nor moved.
    """
    schema = {c.split()[0]: c for c in NODE_SCHEMA.split(", ")}
    wanted = [c for c in NODE_COLUMNS if columns is None or c in columns]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            urls = pdf["url"] if "url" in pdf else [None] * len(pdf)
            rows: list[tuple] = []
            for page_id, url, source in zip(pdf["page_id"], urls, pdf["html"]):
                rows += _rows(page_id, url, tree.parse(source, fragment), wanted)
                if len(rows) >= 20_000:  # pages can be large: small output batches
                    yield _frame(rows, wanted)
                    rows = []
            yield _frame(rows, wanted)

    read = ["page_id", "html", *(["url"] if "url" in wanted else [])]
    return pages.select(*read).mapInPandas(scan, ", ".join(schema[c] for c in wanted))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=columns)
    return found.astype({"parent_id": "Int32"}) if "parent_id" in columns else found


def select(pages: DataFrame, selector: str, *carried: str) -> DataFrame:
    """Matches of a selector as ``page_id, ord, node_id, tag, value, outer_html``, in document order.

    ``value`` is the text for ``::text``, the attribute for ``::attr(..)``, else null;
    ``outer_html`` is null where ``value`` isn't. An invalid selector matches nothing.
    ``carried`` are further columns of ``pages`` to keep beside each match.
    """
    return _matches(pages, selector, carried, "ord int, node_id int, tag string, value string, outer_html string", lambda i, n, v: (i, n.id, n.tag, v if v is None else _clean(v), _clean(tree.outer_html(n)) if v is None else None))


def select_rendered(pages: DataFrame, selector: str, separator: str = " ", strip: bool = True, ignore: tuple[str, ...] = ("script", "style")) -> DataFrame:
    """``page_id, node_id, outer_html, inner_html, all_text`` of the matches of a selector, in the pass that finds them."""
    return _matches(
        pages, selector, (), "node_id int, outer_html string, inner_html string, all_text string",
        lambda i, n, v: (n.id, _clean(tree.outer_html(n)), _clean(tree.inner_html(n)), _clean(tree.all_text(n, separator, strip, ignore, keep_blank=False))),
    )


def _matches(pages: DataFrame, selector: str, carried: tuple[str, ...], schema: str, row) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(pages.dtypes)
    kept = ["page_id", *carried]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, *own in zip(pdf["html"], *[pdf[c] for c in kept]):
                for i, (node, value) in enumerate(select_values(tree.parse(source), selector)):
                    rows.append((*own, *row(i, node, value)))
            yield pd.DataFrame(rows, columns=[*kept, *names])

    return pages.select(*kept, "html").mapInPandas(scan, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", " + schema)


def render(pages: DataFrame, chosen: DataFrame, separator: str = " ", strip: bool = True, ignore: tuple[str, ...] = ("script", "style")) -> DataFrame:
    """``page_id, node_id, outer_html, inner_html, all_text`` of the chosen ``page_id, node_id``.

    Only pages with a chosen node are parsed again; markup is never kept for all nodes.
    """
    wanted = chosen.groupBy("page_id").agg(F.collect_set("node_id").alias("ids"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, source, ids in zip(pdf["page_id"], pdf["html"], pdf["ids"]):
                root, ids = tree.parse(source), set(map(int, ids))
                for node in (root, *root.walk()):
                    if node.id in ids:
                        rows.append((page_id, node.id, _clean(tree.outer_html(node)), _clean(tree.inner_html(node)), _clean(tree.all_text(node, separator, strip, ignore, keep_blank=False))))
            yield pd.DataFrame(rows, columns=["page_id", "node_id", "outer_html", "inner_html", "all_text"])

    return pages.select("page_id", "html").join(wanted, "page_id").mapInPandas(scan, "page_id long, node_id int, outer_html string, inner_html string, all_text string")


# --- selectors over a node table -------------------------------------------------


def _nth(a: int, b: int, n: Column) -> Column:
    if a == 0:
        return n == b
    return (F.pmod(n - b, F.lit(abs(a))) == 0) & ((n - b >= 0) if a > 0 else (n - b <= 0))


def predicate(c: Compound) -> Column:
    """A compound selector as a condition on one node row."""
    out = F.lit(True)
    if c.tag != "*":
        out &= F.col("tag") == c.tag
    for i in c.ids:
        out &= F.coalesce(F.col("attrs")["id"] == i, F.lit(False))
    for x in c.classes:
        out &= F.array_contains("classes", x)
    for name, op, value in c.attrs:
        out &= F.coalesce(_attribute(F.try_element_at("attrs", F.lit(name)), op, value), F.lit(False))
    for name, argument in c.pseudos:
        out &= _pseudo(name, argument)
    return out


def _attribute(actual: Column, op: str, value: str) -> Column:
    if len(op) > 1 and op.endswith("i"):
        actual, value, op = F.lower(actual), value.lower(), op[:-1]
    v = F.lit(value)
    match op:
        case "":
            return actual.isNotNull()
        case "=":
            return actual == v
        case "~=":
            return F.array_contains(F.split(F.trim(actual), r"\s+"), value) if value and not value.isspace() else F.lit(False)
        case "|=":
            return (actual == v) | F.startswith(actual, F.lit(value + "-"))
        case "^=":
            return F.startswith(actual, v) if value else F.lit(False)
        case "$=":
            return F.endswith(actual, v) if value else F.lit(False)
    return F.contains(actual, v) if value else F.lit(False)


def _pseudo(name: str, argument) -> Column:
    match name:
        case "first-child":
            return F.col("elem_idx") == 1
        case "last-child":
            return F.col("elem_idx") == F.col("elem_cnt")
        case "only-child":
            return F.col("elem_cnt") == 1
        case "first-of-type":
            return F.col("type_idx") == 1
        case "last-of-type":
            return F.col("type_idx") == F.col("type_cnt")
        case "only-of-type":
            return F.col("type_cnt") == 1
        case "root":
            return F.col("parent_id").isNull()
        case "empty":
            return F.col("blank")
        case "nth-child":
            return _nth(*argument, F.col("elem_idx"))
        case "nth-last-child":
            return _nth(*argument, F.col("elem_cnt") - F.col("elem_idx") + 1)
        case "nth-of-type":
            return _nth(*argument, F.col("type_idx"))
        case "nth-last-of-type":
            return _nth(*argument, F.col("type_cnt") - F.col("type_idx") + 1)
        case "not" | "is" | "where" if _one_row(argument):
            any_ = F.lit(False)
            for a in argument:
                any_ |= predicate(a.compounds[0])
            return ~any_ if name == "not" else any_
    return F.lit(True)  # asked by a join, see _narrowed


def _one_row(alternatives: tuple[Complex, ...]) -> bool:
    """Whether the alternatives are conditions on one node row, without other nodes."""
    return all(len(a.compounds) == 1 and not _joined(a.compounds[0]) for a in alternatives)


def _joined(c: Compound) -> list[tuple[str, tuple[Complex, ...]]]:
    """The pseudo-classes of a compound that ask for other nodes."""
    return [(name, argument) for name, argument in c.pseudos if name == "has" or name in ("not", "is", "where") and not _one_row(argument)]


def _matching(table: DataFrame, c: Compound) -> DataFrame:
    """Node rows that match a compound: by a condition on the row, then a semi-join or anti-join for each pseudo-class that asks for other nodes."""
    found = table.where(predicate(c))
    for name, alternatives in _joined(c):
        keys = None
        for a in alternatives:
            one = _complex(table, a)
            keys = one if keys is None else keys.unionByName(one)
        if name == "has":
            below = keys.select(F.col("page_id").alias("_p"), F.col("node_id").alias("_n"))
            found = found.join(below, (F.col("page_id") == F.col("_p")) & (F.col("_n") > F.col("node_id")) & (F.col("_n") <= F.col("end_id")), "left_semi")
        else:
            found = found.join(keys.select("page_id", "node_id"), ["page_id", "node_id"], "left_anti" if name == "not" else "left_semi")
    return found


def _complex(table: DataFrame, selector: Complex) -> DataFrame:
    """Node rows that match; each combinator is a semi-join of the matches so far."""
    found = _matching(table, selector.compounds[0])
    for combinator, compound in zip(selector.combinators, selector.compounds[1:]):
        here = _matching(table, compound)
        left = found.select(F.col("page_id").alias("_p"), F.col("node_id").alias("_n"), F.col("end_id").alias("_e"), F.col("parent_id").alias("_u"), F.col("elem_idx").alias("_i"))
        same = F.col("page_id") == F.col("_p")
        condition = {
            ">": F.col("parent_id") == F.col("_n"),
            " ": (F.col("node_id") > F.col("_n")) & (F.col("node_id") <= F.col("_e")),
            "+": (F.col("parent_id") == F.col("_u")) & (F.col("elem_idx") == F.col("_i") + 1),
            "~": (F.col("parent_id") == F.col("_u")) & (F.col("elem_idx") > F.col("_i")),
        }[combinator]
        found = here.join(left, same & condition, "left_semi")
    return found


def css(table: DataFrame, selector: str) -> DataFrame:
    """Rows of a node table that match a selector without pseudo-element; roots are excluded, each match comes once.

    An invalid selector matches nothing.
    """
    try:
        alternatives = parse_selector(CssQuery.parse(selector).css)
    except SelectorError:
        return table.where(F.lit(False))
    inner = table.where(F.col("parent_id").isNotNull())
    if _one_row(alternatives):
        any_ = F.lit(False)
        for a in alternatives:
            any_ |= predicate(a.compounds[0])
        return inner.where(any_)
    keys = None
    for a in alternatives:
        found = _complex(table, a).where(F.col("parent_id").isNotNull())
        keys = found if keys is None else keys.unionByName(found)
    return keys if len(alternatives) == 1 else keys.dropDuplicates(["page_id", "node_id"])


def css_values(table: DataFrame, source: str) -> DataFrame:
    """``page_id, node_id, pos, value`` of ``css`` with ``::text`` or ``::attr(name)``."""
    query = CssQuery.parse(source)
    found = css(table, query.css)
    if query.pseudo == "attr":
        value = F.try_element_at("attrs", F.lit(query.attribute))
        return found.select("page_id", "node_id", F.lit(0).alias("pos"), value.alias("value")).where(F.col("value").isNotNull())
    texts = found.select("page_id", "node_id", F.posexplode("text_chunks").alias("pos", "value"))
    return texts.where(F.regexp_replace("value", r"(?U)\s+", "") != "")


def within(table: DataFrame, context: DataFrame, selector: str) -> DataFrame:
    """For each context node the matches below it; a match below two context nodes comes twice. Adds ``context_id``."""
    found = css(table, selector)
    around = context.select(F.col("page_id").alias("_p"), F.col("node_id").alias("context_id"), F.col("end_id").alias("_e"))
    inside = (F.col("page_id") == F.col("_p")) & (F.col("node_id") > F.col("context_id")) & (F.col("node_id") <= F.col("_e"))
    return found.join(around, inside).drop("_p", "_e")


# --- navigation ------------------------------------------------------------------


def parents(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """The parent row of each chosen node, with ``of_id``; roots have none."""
    keys = chosen.where(F.col("parent_id").isNotNull()).select("page_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("of_id"))
    return table.join(keys, ["page_id", "node_id"])


def children(table: DataFrame, chosen: DataFrame) -> DataFrame:
    keys = chosen.select("page_id", F.col("node_id").alias("parent_id"))
    return table.join(keys, ["page_id", "parent_id"], "left_semi").withColumn("of_id", F.col("parent_id"))


def siblings(table: DataFrame, chosen: DataFrame) -> DataFrame:
    keys = chosen.where(F.col("parent_id").isNotNull()).select("page_id", "parent_id", F.col("node_id").alias("of_id"))
    return table.join(keys, ["page_id", "parent_id"]).where(F.col("node_id") != F.col("of_id"))


def with_neighbours(table: DataFrame) -> DataFrame:
    """Adds ``previous_id`` and ``next_id``, the element siblings beside each node."""
    row = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    return table.withColumns({"previous_id": F.lag("node_id").over(row), "next_id": F.lead("node_id").over(row)})


def ancestors(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of all ancestors with ``of_id`` and ``steps`` (1: parent)."""
    keys = chosen.select("page_id", F.col("node_id").alias("of_id"), F.posexplode("anc_ids").alias("_s", "node_id"))
    return table.join(keys.select("page_id", "of_id", "node_id", (F.col("_s") + 1).alias("steps")), ["page_id", "node_id"])


def descendants(table: DataFrame, chosen: DataFrame) -> DataFrame:
    keys = chosen.select(F.col("page_id").alias("_p"), F.col("node_id").alias("of_id"), F.col("end_id").alias("_e"))
    inside = (F.col("page_id") == F.col("_p")) & (F.col("node_id") > F.col("of_id")) & (F.col("node_id") <= F.col("_e"))
    return table.join(keys, inside).drop("_p", "_e")


def nearest_ancestor(table: DataFrame, chosen: DataFrame, condition: Column) -> DataFrame:
    """For each chosen node the nearest ancestor that meets the condition: ``page_id, of_id, node_id``."""
    found = ancestors(table, chosen).where(condition)
    return found.groupBy("page_id", "of_id").agg(F.min_by("node_id", "steps").alias("node_id"))


# --- finding ---------------------------------------------------------------------


def find_all(table: DataFrame, tags: tuple[str, ...] = (), attrs: dict[str, str] | None = None, patterns: tuple[str, ...] = (), condition: Column | None = None) -> DataFrame:
    """Nodes of one of the tags, with all attribute values, whose own text has all patterns, and that meet the condition.

    Nothing asked finds nothing. Empty own text has no pattern.
    """
    from weftline.functions.text import re_matches

    if not tags and not attrs and not patterns and condition is None:
        return table.where(F.lit(False))
    found = table.where(F.col("parent_id").isNotNull())
    if tags:
        found = found.where(F.col("tag").isin(*tags))
    for name, value in (attrs or {}).items():
        found = found.where(F.try_element_at("attrs", F.lit(name)) == value)
    for pattern in patterns:
        found = found.where((F.col("own_text") != "") & re_matches("own_text", pattern))
    return found if condition is None else found.where(condition)


def first(found: DataFrame) -> DataFrame:
    """The first of the found nodes on each page."""
    row = Window.partitionBy("page_id").orderBy("node_id")
    return found.withColumn("_r", F.row_number().over(row)).where("_r = 1").drop("_r")


def find_by_text(table: DataFrame, text: str, partial: bool = False, case_sensitive: bool = True, clean_match: bool = False) -> DataFrame:
    from weftline.functions.text import clean

    own = clean("own_text") if clean_match else F.col("own_text")
    wanted = F.lit(text)
    if not case_sensitive:
        own, wanted = F.lower(own), F.lit(text.lower())
    hit = F.contains(own, wanted) if partial else own == wanted
    return table.where(F.col("parent_id").isNotNull() & (F.col("own_text") != "") & hit)


def find_by_regex(table: DataFrame, pattern: str, case_sensitive: bool = True, clean_match: bool = False) -> DataFrame:
    from weftline.functions.text import clean, re_matches

    own = clean("own_text") if clean_match else F.col("own_text")
    return table.where(F.col("parent_id").isNotNull() & (F.col("own_text") != "") & re_matches(own, pattern, case_sensitive))


def node_re(found: DataFrame, pattern: str, **options) -> DataFrame:
    """``page_id, node_id, pos, match``: all matches in the nodes' own texts, as ``text.re_all`` gives them."""
    from weftline.functions.text import re_all

    matches = found.select("page_id", "node_id", re_all("own_text", pattern, **options).alias("_m"))
    return matches.select("page_id", "node_id", F.posexplode("_m").alias("pos", "match"))


def node_re_first(found: DataFrame, pattern: str, default: str | None = None, **options) -> DataFrame:
    """``page_id, match``: the first match on each page of ``found``, or the default."""
    first_match = node_re(found, pattern, **options).groupBy("page_id").agg(F.min_by("match", F.struct("node_id", "pos")).alias("match"))
    return found.select("page_id").distinct().join(first_match, "page_id", "left").select("page_id", F.coalesce("match", F.lit(default)).alias("match"))


# --- generated selectors ---------------------------------------------------------


def generated_selectors(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """``page_id, node_id, css, full_css, xpath, full_xpath`` of the chosen nodes.

    A step is the tag, with its place among siblings of the tag if there are any. The
    short forms end at the nearest id above and leave html out; the full forms don't.
    """
    steps = F.struct("tag", F.try_element_at("attrs", F.lit("id")).alias("id"), "type_idx", "type_cnt")
    own = chosen.select("page_id", F.col("node_id").alias("of_id"), F.lit(0).alias("steps"), steps.alias("step"))
    up = ancestors(table, chosen).select("page_id", "of_id", "steps", steps.alias("step"))
    chain = own.unionByName(up).groupBy("page_id", "of_id").agg(F.array_sort(F.collect_list(F.struct("steps", "step"))).alias("_c"))
    lines = F.transform("_c", lambda c: c["step"])
    has_id = lambda s: F.coalesce(s["id"], F.lit("")) != ""
    at = F.array_position(F.transform(lines, has_id), True).cast("int")
    near = F.filter(F.when(at > 0, F.slice(lines, F.lit(1), at)).otherwise(lines), lambda s: (s["tag"] != "html") | has_id(s))
    place = lambda s: F.coalesce(s["type_cnt"], F.lit(1)) > 1
    css_step = lambda s: F.when(has_id(s), F.concat(F.lit("#"), s["id"])).when(place(s), F.concat(s["tag"], F.lit(":nth-of-type("), s["type_idx"].cast("string"), F.lit(")"))).otherwise(s["tag"])
    xpath_step = lambda s: F.when(has_id(s), F.concat(s["tag"], F.lit("[@id='"), s["id"], F.lit("']"))).when(place(s), F.concat(s["tag"], F.lit("["), s["type_idx"].cast("string"), F.lit("]"))).otherwise(s["tag"])
    put = lambda a, f, j: F.array_join(F.reverse(F.transform(a, f)), j)
    return chain.select(
        "page_id", F.col("of_id").alias("node_id"), put(near, css_step, " > ").alias("css"), put(lines, css_step, " > ").alias("full_css"),
        F.concat(F.lit("//"), put(near, xpath_step, "/")).alias("xpath"), F.concat(F.lit("//"), put(lines, xpath_step, "/")).alias("full_xpath"),
    )
