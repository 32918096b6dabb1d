"""HTML pages as trees: an error-recovering builder after the WHATWG rules, and a serialiser.

Covered: implied html, head and body; raw text elements; void elements; elements that
close an open p, li, dt, dd, option or table part; active formatting elements with
reconstruction and the adoption agency; foster parenting of content misplaced in tables.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul"
    " h1 h2 h3 h4 h5 h6 pre listing form table hr xmp plaintext".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
SPECIAL = BLOCKS | SCOPE | frozenset("body head tbody tfoot thead tr li dd dt button select br img input link meta script style textarea title iframe colgroup col embed frame".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())

TOKEN = re.compile(r"<!--(.*?)(?:-->|--!>|\Z)|<!([^>]*)>|<\?([^>]*)>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")


class Comment(str):
    """The text of a comment."""


class Node:
    """An element. ``children`` holds elements, text (``str``) and comments in order."""

    __slots__ = ("tag", "attrs", "children", "parent", "id", "end", "depth", "index", "type_index", "type_count", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None
        self.id = self.end = self.depth = self.index = self.type_index = self.type_count = 0
        self.kids: list[Node] = []  # the child elements, once the tree is numbered

    def append(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.detach()
            child.parent = self
        elif type(child) is str and self.children and type(self.children[-1]) is str:
            self.children[-1] += child
            return
        self.children.append(child)

    def insert_before(self, child: Node | str, mark: Node) -> None:
        at = next(i for i, c in enumerate(self.children) if c is mark)
        if isinstance(child, Node):
            child.detach()
            at = next(i for i, c in enumerate(self.children) if c is mark)
            child.parent = self
        elif at and type(self.children[at - 1]) is str and type(child) is str:
            self.children[at - 1] += child
            return
        self.children.insert(at, child)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def element_count(self) -> int:
        return len(self.kids)

    def element(self, index: int) -> Node:
        """The child element of this index, from 1."""
        return self.kids[index - 1]

    def texts(self) -> list[str]:
        return [c for c in self.children if type(c) is str]

    def own_text(self) -> str:
        return "".join(self.texts())

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        value = double or single or bare
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


class Builder:
    def __init__(self, fragment: bool = False):
        self.root = Node("html")
        self.stack = [self.root]
        self.active: list[Node | None] = []  # None marks a scope
        self.head: Node | None = None
        self.body: Node | None = None
        self.fragment = fragment
        self.closed_head = False
        if fragment:
            self.body = self.root

    # -- helpers
    @property
    def current(self) -> Node:
        return self.stack[-1]

    def in_scope(self, names: frozenset[str] | set[str], barrier: frozenset[str] = SCOPE) -> bool:
        for node in reversed(self.stack):
            if node.tag in names:
                return True
            if node.tag in barrier:
                return False
        return False

    def pop_until(self, names: frozenset[str] | set[str]) -> None:
        while len(self.stack) > 1:
            if self.stack.pop().tag in names:
                return

    def need_body(self) -> None:
        if self.body is None:
            self.need_head()
            self.stack = [self.root]
            self.body = Node("body")
            self.root.append(self.body)
            self.stack.append(self.body)

    def need_head(self) -> None:
        if self.head is None:
            self.head = Node("head")
            self.root.append(self.head)

    def insert(self, child: Node | str) -> None:
        here = self.current
        misplaced = here.tag in ("table", "tbody", "thead", "tfoot", "tr")
        if misplaced and (isinstance(child, Node) and child.tag not in TABLE_PARTS | {"script", "style", "template"} or type(child) is str and child.strip()):
            table = next(n for n in reversed(self.stack) if n.tag in ("table", "html"))
            if table.parent is not None:
                table.parent.insert_before(child, table)
                return
        here.append(child)

    def open(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.insert(node)
        self.stack.append(node)
        return node

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        at = len(self.active) - 1
        while at > 0 and self.active[at - 1] is not None and self.active[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(self.active)):
            old = self.active[i]
            self.active[i] = self.open(old.tag, dict(old.attrs))

    def close_p(self) -> None:
        if self.in_scope({"p"}, SCOPE | {"button"}):
            self.pop_until({"p"})

    def close_implied(self, but: str = "") -> None:
        while self.current.tag in ("dd", "dt", "li", "optgroup", "option", "p", "rb", "rp", "rt", "rtc") and self.current.tag != but:
            self.stack.pop()

    # -- tokens
    def text(self, data: str) -> None:
        if not data:
            return
        if self.body is None:
            if self.current is not self.root and self.current.tag in ("title", "textarea") + tuple(RAW):
                self.current.append(data)
                return
            rest = data.lstrip(" \t\n\r\f")
            if not rest:
                if self.head is not None and self.current is self.head:
                    self.head.append(data)
                return
            data = rest
            self.need_body()
        if not self.fragment or data.strip():
            if data.strip(" \t\n\r\f"):
                self.reconstruct()
        self.insert(data)

    def comment(self, data: str) -> None:
        self.current.append(Comment(data))

    def start(self, tag: str, attrs: dict[str, str], closes_itself: bool) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag == "head":
                if self.head is None:
                    self.head = Node("head", attrs)
                    self.root.append(self.head)
                    self.stack = [self.root, self.head]
                return
            if tag in HEAD_ONLY:
                self.need_head()
                if self.current is self.root:
                    self.stack = [self.root, self.head]
                node = self.open(tag, attrs)
                if tag in VOID or closes_itself:
                    self.stack.pop()
                if self.closed_head:
                    self.stack = [self.root] + ([node] if node in self.stack else [])
                return
            if tag == "body":
                self.need_head()
                self.stack = [self.root]
                self.body = Node("body", attrs)
                self.root.append(self.body)
                self.stack.append(self.body)
                return
            self.need_body()
        elif tag == "body":
            if self.body is not None:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return
        elif tag in ("head", "frameset"):
            return
        if tag in TABLE_PARTS:
            if self.table_part(tag, attrs):
                return
            if not self.fragment:
                return
        if tag in BLOCKS and tag not in ("form",):
            if tag != "table":
                self.close_p()
            else:
                self.close_p()
            if tag in HEADINGS and self.current.tag in HEADINGS:
                self.stack.pop()
        elif tag == "form":
            if self.in_scope({"form"}):
                return
            self.close_p()
        elif tag == "li":
            for node in reversed(self.stack):
                if node.tag == "li":
                    self.close_implied("li")
                    self.pop_until({"li"})
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag in ("dd", "dt"):
            for node in reversed(self.stack):
                if node.tag in ("dd", "dt"):
                    self.close_implied(node.tag)
                    self.pop_until({node.tag})
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag in ("option", "optgroup"):
            if self.current.tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.current.tag == "optgroup":
                self.stack.pop()
            self.reconstruct()
        elif tag == "button":
            if self.in_scope({"button"}):
                self.pop_until({"button"})
            self.reconstruct()
        elif tag in FORMATTING:
            if tag == "a":
                for old in reversed(self.active):
                    if old is None:
                        break
                    if old.tag == "a":
                        self.adopt("a")
                        self.active = [n for n in self.active if n is not old]
                        self.stack = [n for n in self.stack if n is not old]
                        break
            elif tag == "nobr" and self.in_scope({"nobr"}):
                self.adopt("nobr")
            self.reconstruct()
            node = self.open(tag, attrs)
            same = [n for n in self.active if n is not None and n.tag == tag and n.attrs == attrs]
            if len(same) >= 3:
                self.active.remove(same[0])
            self.active.append(node)
            return
        elif tag not in HEAD_ONLY:
            if tag == "image":
                tag = "img"
            self.reconstruct()
        node = self.open(tag, attrs)
        if tag in ("applet", "marquee", "object"):
            self.active.append(None)
        if tag in VOID or closes_itself and tag in ("svg", "math", "path"):
            self.stack.pop()

    def table_part(self, tag: str, attrs: dict[str, str]) -> bool:
        if not self.in_scope({"table"}, frozenset({"html", "template"})):
            return False
        if tag in ("td", "th"):
            if self.in_scope({"td", "th"}, frozenset({"table", "html"})):
                self.pop_until({"td", "th"})
                self.clear_scope()
            while self.current.tag not in ("tr", "tbody", "thead", "tfoot", "table", "html"):
                self.stack.pop()
            if self.current.tag == "table":
                self.open("tbody", {})
            if self.current.tag != "tr":
                self.open("tr", {})
            self.open(tag, attrs)
            self.active.append(None)
            return True
        if self.in_scope({"td", "th"}, frozenset({"table", "html"})):
            self.pop_until({"td", "th"})
            self.clear_scope()
        stops = {"tr": ("tbody", "thead", "tfoot", "table", "html"), "col": ("colgroup", "table", "html")}.get(tag, ("table", "html"))
        while self.current.tag not in stops:
            self.stack.pop()
        if tag == "tr" and self.current.tag == "table":
            self.open("tbody", {})
        if tag == "col" and self.current.tag == "table":
            self.open("colgroup", {})
        self.open(tag, attrs)
        if tag == "col":
            self.stack.pop()
        elif tag == "caption":
            self.active.append(None)
        return True

    def clear_scope(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if self.body is None:
            if tag == "head":
                self.need_head()
                self.stack, self.closed_head = [self.root], True
            elif self.current is not self.root and self.current.tag == tag:
                self.stack.pop()
            elif tag == "br":
                self.start("br", {}, False)
            return
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p":
            if not self.in_scope({"p"}, SCOPE | {"button"}):
                self.open("p", {})
            self.close_implied("p")
            self.pop_until({"p"})
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.close_implied()
                self.pop_until(HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("td", "th", "caption"):
            if self.in_scope({tag}, frozenset({"table", "html"})):
                self.pop_until({tag})
                self.clear_scope()
        elif tag in ("tr", "tbody", "thead", "tfoot", "table"):
            if self.in_scope({tag}, frozenset({"html", "template"}) if tag == "table" else frozenset({"table", "html"})):
                while self.current.tag != tag:
                    node = self.stack.pop()
                    if node.tag in ("td", "th", "caption"):
                        self.clear_scope()
                self.stack.pop()
        elif tag == "li":
            if self.in_scope({"li"}, SCOPE | {"ol", "ul"}):
                self.close_implied("li")
                self.pop_until({"li"})
        elif tag in BLOCKS or tag in ("dd", "dt", "button"):
            if self.in_scope({tag}):
                self.close_implied(tag)
                self.pop_until({tag})
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope({tag}):
                self.pop_until({tag})
                self.clear_scope()
        else:
            self.any_end(tag)

    def any_end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if self.stack[i].tag in SPECIAL:
                return

    def adopt(self, tag: str) -> None:
        """The adoption agency: close a formatting element that blocks were opened in."""
        if self.current.tag == tag and self.current not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            mark = None
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == tag:
                    mark = node
                    break
            if mark is None:
                self.any_end(tag)
                return
            if mark not in self.stack:
                self.active.remove(mark)
                return
            if not self.in_scope({tag}):
                return
            at = self.stack.index(mark)
            block = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(mark)
                return
            above = self.stack[at - 1]
            place = self.active.index(mark)
            last = block
            i = self.stack.index(block)
            for turn in range(1, 100):
                i -= 1
                node = self.stack[i]
                if node is mark:
                    break
                if turn > 3 and node in self.active:
                    if self.active.index(node) < place:
                        place -= 1
                    self.active.remove(node)
                if node not in self.active:
                    self.stack.remove(node)
                    continue
                copy = Node(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = copy
                self.stack[i] = copy
                if last is block:
                    place = self.active.index(copy) + 1
                copy.append(last)
                last = copy
            last.detach()
            if above.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                table = next((n for n in reversed(self.stack[:at]) if n.tag == "table"), None)
                if table is not None and table.parent is not None:
                    table.parent.insert_before(last, table)
                else:
                    above.append(last)
            else:
                above.append(last)
            copy = Node(mark.tag, dict(mark.attrs))
            moved, block.children = block.children, []
            for child in moved:
                if isinstance(child, Node):
                    child.parent = None
                copy.append(child)
            block.append(copy)
            old = self.active.index(mark)
            self.active.remove(mark)
            self.active.insert(place - 1 if old < place else place, copy)
            self.stack.remove(mark)
            self.stack.insert(self.stack.index(block) + 1, copy)


def parse(source: str | None, fragment: bool = False) -> Node:
    """The root element (html) of a page. Never fails: an empty or null page is html with head and body."""
    source = source or ""
    builder = Builder(fragment)
    at, size = 0, len(source)
    next_loose = LOOSE.search(source)
    while at < size:
        token = TOKEN.search(source, at)
        if next_loose is not None and next_loose.start() < at:
            next_loose = LOOSE.search(source, at)
        loose = next_loose
        if loose is not None and (token is None or loose.start() < token.start()):
            token, groups = loose, (None, None, None, loose[1], loose[2], loose[3])  # an unbalanced quote in a tag
        elif token is None:
            break
        else:
            groups = token.groups()
        if token.start() > at:
            data = source[at : token.start()]
            builder.text(html.unescape(data) if "&" in data else data)
        at = token.end()
        comment, declaration, instruction, slash, name, rest = groups
        if name is None:
            if comment is not None:
                builder.comment(comment)
            elif instruction is not None:
                builder.comment("?" + instruction)
            continue
        name = name.lower()
        if slash:
            builder.end(name)
            continue
        builder.start(name, attributes(rest) if rest.strip() else {}, rest.endswith("/"))
        if name in RAW or name in ESCAPABLE_RAW:
            node = builder.current
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            data = source[at : stop.start() if stop else size]
            if name in ESCAPABLE_RAW:
                data = html.unescape(data)
            if node.tag == name and data:
                node.append(data.removeprefix("\n") if name == "textarea" else data)
            at = stop.end() if stop else size
            if node.tag == name:
                builder.stack.pop()
    if at < size:
        data = source[at:]
        builder.text(html.unescape(data) if "&" in data else data)
    if not fragment:
        builder.need_head()
        builder.need_body()
    return number(builder.root)


def number(root: Node) -> Node:
    """Give each element its place: pre-order number, last descendant, depth, sibling positions."""
    count = -1
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            node.end = count
            continue
        count += 1
        node.id = count
        node.depth = node.parent.depth + 1 if node.parent is not None else 0
        todo.append((node, True))
        kids = node.kids = node.elements()
        seen: dict[str, int] = {}
        for i, kid in enumerate(kids, 1):
            kid.index, kid.type_index = i, seen.get(kid.tag, 0) + 1
            seen[kid.tag] = kid.type_index
        for kid in kids:
            kid.type_count = seen[kid.tag]
        todo += [(k, False) for k in reversed(kids)]
    root.index = root.type_index = root.type_count = 1
    return root


def escape(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def outer_html(node: Node) -> str:
    """The element with its tags. Text is not escaped again; void elements have no end tag."""
    return _markup([node])


def inner_html(node: Node) -> str:
    return _markup(node.children)


def _markup(parts: list) -> str:
    """Markup of elements, comments and text, however deep they lie."""
    out: list[str] = []
    todo: list = [(p, False) for p in reversed(parts)]
    while todo:
        part, end = todo.pop()
        if end:
            out.append(part)
        elif isinstance(part, Node):
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in part.attrs.items())
            out.append(f"<{part.tag}{attrs}>")
            if part.tag not in VOID:
                todo.append((f"</{part.tag}>", True))
                todo += [(c, False) for c in reversed(part.children)]
        else:
            out.append(f"<!--{part}-->" if isinstance(part, Comment) else part)
    return "".join(out)


def all_text(node: Node, separator: str = "", strip: bool = False, ignore: tuple[str, ...] = (), keep_blank: bool = True) -> str:
    """The text of the subtree in document order. ``ignore`` prunes subtrees, not the element itself."""
    out: list[str] = []
    todo: list = list(reversed(node.children))
    while todo:
        part = todo.pop()
        if isinstance(part, Node):
            if part.tag not in ignore:
                todo += reversed(part.children)
        elif not isinstance(part, Comment):
            text = part.strip() if strip else part
            if keep_blank or text.strip():
                out.append(text)
    return separator.join(out)
