"""CSS selectors: parsing, matching on trees, and translation to XPath."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from weftline.functions.tree import Node


class SelectorError(ValueError):
    """A selector that can't be read."""


@dataclass(frozen=True)
class CssQuery:
    """A selector with its pseudo-element: ``pseudo`` is null, "text" or "attr"."""

    css: str
    pseudo: str | None = None
    attribute: str | None = None

    @staticmethod
    def parse(source: str) -> CssQuery:
        """Split off a final ``::text`` or ``::attr(name)``; alone it stands for ``*``. It holds for the whole list."""
        text = source.strip()
        if text.endswith("::text"):
            return CssQuery(text[:-6].strip() or "*", "text")
        found = re.search(r"::attr\(([^()]*)\)$", text)
        if found:
            name = found[1].strip().strip("\"'")
            if not name:
                raise SelectorError("::attr() needs a name")
            return CssQuery(text[: found.start()].strip() or "*", "attr", name)
        if "::" in text:
            raise SelectorError(f"unknown pseudo-element in {source!r}")
        return CssQuery(text)


@dataclass(frozen=True)
class Compound:
    """Simple selectors on one element. ``attrs``: (name, operator, value); ``pseudos``: (name, argument).

    ``order`` has all of them but the tag as written: (kind, value), a position as its text.
    """

    tag: str = "*"
    ids: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str], ...] = ()
    pseudos: tuple[tuple[str, object], ...] = ()
    order: tuple[tuple[str, object], ...] = field(default=(), compare=False)


@dataclass(frozen=True)
class Complex:
    """Compounds from left to right, with the combinator before each but the first."""

    compounds: tuple[Compound, ...]
    combinators: tuple[str, ...] = field(default=())


NAME = r"-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.)(?:[\w\u0080-\U0010ffff-]|\\.)*"
PART = re.compile(
    rf"(?P<tag>{NAME}|\*)|#(?P<id>(?:[\w\u0080-\U0010ffff-]|\\.)+)|\.(?P<cls>{NAME})"
    rf"|\[\s*(?P<attr>[\w:\u0080-\U0010ffff-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s\"']+))\s*(?P<flag>[iIsS])?\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?P<paren>\()?"
)
COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
PLAIN_PSEUDOS = frozenset("first-child last-child only-child first-of-type last-of-type only-of-type empty root".split())


def nth(argument: str) -> tuple[int, int]:
    """``an+b`` as (a, b)."""
    text = argument.strip().lower().replace(" ", "")
    if text in ("odd", "even"):
        return (2, 1) if text == "odd" else (2, 0)
    found = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not found:
        raise SelectorError(f"bad position {argument!r}")
    if found[3] is not None:
        return 0, int(found[3])
    a = {"": 1, "+": 1, "-": -1}.get(found[1]) if found[1] in ("", "+", "-") else int(found[1])
    return a, int(found[2] or 0)


@functools.lru_cache(1024)
def parse_selector(source: str) -> tuple[Complex, ...]:
    """The alternatives of a selector list. Raises ``SelectorError``."""
    out, at = [], 0
    source = source.strip()
    while True:
        found, at = _complex(source, at)
        out.append(found)
        if at >= len(source):
            return tuple(out)
        if source[at] != ",":
            raise SelectorError(f"unexpected {source[at]!r} in {source!r}")
        at += 1
        while at < len(source) and source[at].isspace():
            at += 1


def _complex(source: str, at: int, stop: str = ",") -> tuple[Complex, int]:
    compounds, combinators = [], []
    while True:
        compound, at = _compound(source, at)
        compounds.append(compound)
        between = COMBINATOR.match(source, at)
        if not between or between.end() == at:
            break
        after = between.end()
        if after >= len(source) or source[after] in stop + ")":
            if between[1]:
                raise SelectorError(f"nothing after {between[1]!r}")
            at = after
            break
        combinators.append(between[1] or " ")
        at = after
    return Complex(tuple(compounds), tuple(combinators)), at


def _compound(source: str, at: int) -> tuple[Compound, int]:
    tag, ids, classes, attrs, pseudos, order = "*", [], [], [], [], []
    begun = at
    while at < len(source):
        part = PART.match(source, at)
        if not part:
            break
        if part["tag"]:
            if at != begun:
                break
            tag = part["tag"].lower()
        elif part["id"]:
            ids.append(part["id"].replace("\\", ""))
            order.append(("id", ids[-1]))
        elif part["cls"]:
            classes.append(part["cls"].replace("\\", ""))
            order.append(("class", classes[-1]))
        elif part["attr"]:
            value = next((part[v] for v in ("v1", "v2", "v3") if part[v] is not None), "")
            op = part["op"] or ""
            attrs.append((part["attr"].lower(), op + ("i" if (part["flag"] or "").lower() == "i" else ""), value))
            order.append(("attr", attrs[-1]))
        else:
            name, at = part["pseudo"], part.end()
            if part["paren"]:
                depth, start = 1, at
                while at < len(source) and depth:
                    depth += {"(": 1, ")": -1}.get(source[at], 0)
                    at += 1
                if depth:
                    raise SelectorError("unclosed bracket")
                argument = source[start : at - 1]
                if name in ("not", "is", "where", "has"):
                    pseudos.append((name, parse_selector(argument)))
                    order.append(pseudos[-1])
                elif name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type"):
                    pseudos.append((name, nth(argument)))
                    order.append((name, argument.strip()))
                else:
                    raise SelectorError(f"unknown pseudo-class :{name}()")
            elif name in PLAIN_PSEUDOS:
                pseudos.append((name, None))
                order.append(pseudos[-1])
            else:
                raise SelectorError(f"unknown pseudo-class :{name}")
            continue
        at = part.end()
    if at == begun:
        raise SelectorError(f"expected a selector at {source[at:]!r}")
    return Compound(tag, tuple(ids), tuple(classes), tuple(attrs), tuple(pseudos), tuple(order)), at


# --- matching --------------------------------------------------------------------


def attribute_matches(value: str | None, op: str, wanted: str) -> bool:
    if value is None:
        return False
    if op.endswith("i") and len(op) > 1:
        value, wanted, op = value.lower(), wanted.lower(), op[:-1]
    match op:
        case "":
            return True
        case "=":
            return value == wanted
        case "~=":
            return bool(wanted) and not re.search(r"\s", wanted) and wanted in value.split()
        case "|=":
            return value == wanted or value.startswith(wanted + "-")
        case "^=":
            return bool(wanted) and value.startswith(wanted)
        case "$=":
            return bool(wanted) and value.endswith(wanted)
        case "*=":
            return bool(wanted) and wanted in value
    return False


def _position(a: int, b: int, n: int) -> bool:
    return n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0


def compound_matches(node: Node, c: Compound) -> bool:
    if c.tag != "*" and node.tag != c.tag:
        return False
    if c.ids and any(node.attrs.get("id") != i for i in c.ids):
        return False
    if c.classes:
        own = node.classes()
        if any(x not in own for x in c.classes):
            return False
    if any(not attribute_matches(node.attrs.get(n), op, v) for n, op, v in c.attrs):
        return False
    return all(_pseudo(node, name, argument) for name, argument in c.pseudos)


def _pseudo(node: Node, name: str, argument) -> bool:
    total = node.parent.element_count() if node.parent is not None else 1
    match name:
        case "first-child":
            return node.index == 1
        case "last-child":
            return node.index == total
        case "only-child":
            return total == 1
        case "first-of-type":
            return node.type_index == 1
        case "last-of-type":
            return node.type_index == node.type_count
        case "only-of-type":
            return node.type_count == 1
        case "root":
            return node.parent is None
        case "empty":
            return not any(isinstance(c, Node) or type(c) is str and c for c in node.children)
        case "nth-child":
            return _position(*argument, node.index)
        case "nth-last-child":
            return _position(*argument, total - node.index + 1)
        case "nth-of-type":
            return _position(*argument, node.type_index)
        case "nth-last-of-type":
            return _position(*argument, node.type_count - node.type_index + 1)
        case "not":
            return not any(complex_matches(node, c) for c in argument)
        case "is" | "where":
            return any(complex_matches(node, c) for c in argument)
        case "has":
            return any(complex_matches(d, c) for d in node.walk() for c in argument)
    return False


def complex_matches(node: Node, selector: Complex, firsts: dict[tuple[int, int], int] | None = None) -> bool:
    """``firsts`` keeps, for one tree and one selector, what was found out about siblings."""
    firsts = {} if firsts is None else firsts

    def left(n: Node, i: int) -> bool:
        """Whether ``n`` matches compound ``i`` and what stands before it."""
        if not compound_matches(n, selector.compounds[i]):
            return False
        if i == 0:
            return True
        match selector.combinators[i - 1]:
            case ">":
                return n.parent is not None and left(n.parent, i - 1)
            case " ":
                return any(left(a, i - 1) for a in n.ancestors())
            case "+":
                return n.parent is not None and n.index > 1 and left(n.parent.element(n.index - 1), i - 1)
            case _:
                # the first sibling that matches is asked for once for each parent, not for each sibling after it
                if n.parent is None or n.index < 2:
                    return False
                key = (id(n.parent), i)
                if key not in firsts:
                    firsts[key] = next((k for k in range(1, n.parent.element_count() + 1) if left(n.parent.element(k), i - 1)), 1 << 62)
                return firsts[key] < n.index

    return left(node, len(selector.compounds) - 1)


def select(root: Node, css: str) -> list[Node]:
    """Matching descendants in document order, the root itself excluded. An invalid selector matches nothing."""
    try:
        alternatives = parse_selector(css)
    except SelectorError:
        return []
    known: list[dict[tuple[int, int], int]] = [{} for _ in alternatives]
    return [n for n in root.walk() if any(complex_matches(n, a, k) for a, k in zip(alternatives, known))]


def select_values(root: Node, source: str) -> list[tuple[Node, str | None]]:
    """Matches with their value: null for elements, each direct text that isn't blank for ``::text``, the value for ``::attr``."""
    try:
        query = CssQuery.parse(source)
    except SelectorError:
        return []
    found = select(root, query.css)
    if query.pseudo == "text":
        return [(n, t) for n in found for t in n.texts() if t.strip()]
    if query.pseudo == "attr":
        return [(n, n.attrs[query.attribute]) for n in found if query.attribute in n.attrs]
    return [(n, None) for n in found]


# --- XPath -----------------------------------------------------------------------

#: Pseudo-classes that are a condition on the position.
POSITIONS = {"first-child": "position()=1", "last-child": "position()=last()", "only-child": "last()=1", "empty": "not(*)"}


@functools.lru_cache(256)
def css_to_xpath(source: str) -> str:
    """A selector as XPath. What follows the first comma is left out. Raises ``SelectorError``."""
    query = CssQuery.parse(source)
    steps = _xpath(query.css.split(",")[0].strip())
    return steps + {"text": "/text()", "attr": f"/@{query.attribute}"}.get(query.pseudo, "")


def _xpath(css: str) -> str:
    complex_, at = _complex(css, 0)
    if at < len(css):
        raise SelectorError(f"unexpected {css[at]!r}")
    out = ""
    for i, compound in enumerate(complex_.compounds):
        axis = "descendant-or-self::" if i == 0 else {" ": "//", ">": "/", "+": "/following-sibling::", "~": "/following-sibling::"}[complex_.combinators[i - 1]]
        first = "[1]" if i and complex_.combinators[i - 1] == "+" else ""
        out += axis + compound.tag + first + _predicates(compound)
    return out


def _predicates(c: Compound) -> str:
    """The simple selectors as written, one predicate for each. A position is put down as its text."""
    return "".join(f"[{_predicate(kind, value)}]" for kind, value in c.order)


def _predicate(kind: str, value) -> str:
    match kind:
        case "class":
            return f"contains(concat(' ', normalize-space(@class), ' '), ' {value} ')"
        case "id":
            return f"@id='{value}'"
        case "attr":
            name, op, raw = value
            text = raw.replace("'", "\\'")
            return {
                "": f"@{name}",
                "=": f"@{name}='{text}'",
                "~=": f"contains(concat(' ', @{name}, ' '), ' {text} ')",
                "^=": f"starts-with(@{name}, '{text}')",
                "$=": f"substring(@{name}, string-length(@{name}) - {len(raw.encode())} + 1) = '{text}'",
                "*=": f"contains(@{name}, '{text}')",
                "|=": f"@{name}='{text}' or starts-with(@{name}, '{text}-')",
            }[op.rstrip("i") if op else ""]
        case "nth-child":
            return f"position()={value}"
        case "not":
            inner = value[0].compounds[0]
            return f"not(self::{inner.tag}{_predicates(inner)})"
    if kind not in POSITIONS:
        raise SelectorError(f":{kind} has no translation")
    return POSITIONS[kind]
