"""Pages as blocks of text, and the blocks that a site repeats.

``page_blocks`` cuts a page into blocks: comments and the elements head, script,
style, noscript and template are left out, the text is cut at every tag but the
inline ones, and white space is folded. Each block knows the elements around it, so
that a page's own container can be told from the frame.

``repeated_blocks`` is the suffix array of a site: the pages' token streams are
concatenated, suffixes are sorted to a depth of ``WINDOW`` tokens by prefix doubling,
and the tokens of substrings that come back on a good share of the distinct pages are
covered. Whole lines are boilerplate by a fixed count of distinct pages as well, so that
rotating prompts fall away on large sites too.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

#: The elements that don't cut text, and those left out.
INLINE = frozenset("a abbr b code em i mark small span strong time".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)(?=[\s>/])[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
HEAD = re.compile(r"<head(?=[\s>])[^>]*>.*?(?:</head\s*>|(?=<body[\s>]))", re.S | re.I)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>|<[!?][^>]*>")
SPACE = re.compile("[ \t\r\n\f\xa0]+")
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
NOSCRIPT = re.compile(r"<noscript[^>]*>(.*?)</noscript", re.S | re.I)
TOKEN = re.compile(r"\w+|[^\w\s]")
FOREIGN = re.compile(r"[^\x00-\x7f]+")
GARBLED = re.compile("[\x80-\x9f\ufffd]|[\u00c2-\u00f4][\u00a0-\u00bf\u0152-\u0178\u02c6\u02dc\u2013-\u2122]")
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)

WINDOW = 8
SHARE = 0.3
#: A line is boilerplate of its site from so many distinct pages on, however many the site has:
#: ASIDE_PAGES if it also stands beside the content somewhere, else PAGES if it is a longer line without digits.
ASIDE_PAGES = 3
PAGES = 5
#: Words of a line below which only the share counts.
ASIDE_WORDS = 4
WORDS = 7
ASCII_WORD = re.compile(r"[A-Za-z0-9]")
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
OWN_BLOCKS = 3
BESIDE = frozenset("aside nav footer".split())
ITEMS = frozenset("li dt dd td th blockquote pre code figcaption".split())


def squeeze(text: str) -> str:
    """References resolved, white space folded and trimmed."""
    if "&" in text:
        text = html.unescape(text)
    text = text.strip(" \t\r\n\f\xa0")
    if "\n" in text or "  " in text or "\xa0" in text or "\t" in text or "\r" in text or "\f" in text:
        text = SPACE.sub(" ", text)
    return text


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # numbers of the open elements, outermost first
    tags: tuple[str, ...]  # their names
    linked: int = 0  # characters inside links
    links: int = 0
    covered: bool = False


@dataclass
class Page:
    key: tuple
    title: str = ""
    blocks: list[Block] = field(default_factory=list)
    noscript: str = ""


def page_blocks(source: str, key: tuple = ()) -> Page:
    """Cut one page into blocks. Never fails; an empty page has no blocks."""
    title = TITLE.search(source)
    page = Page(key, squeeze(title[1]) if title else "")
    body = HEAD.sub("", source, count=1)
    if "noscript" in body or "NOSCRIPT" in body:
        page.noscript = " ".join(squeeze(TAG.sub(" ", x)) for x in NOSCRIPT.findall(body))
    body = HIDDEN.sub("", body)

    names: list[str] = []
    ids: list[int] = []
    parts: list[str] = []
    count = linked = links = 0
    link_from = None  # index in parts where the open link began
    blocks = page.blocks

    def flush() -> None:
        nonlocal parts, linked, links, link_from
        if not parts:
            linked = links = 0
            link_from = None if link_from is None else 0
            return
        if link_from is not None:
            linked += len(squeeze("".join(parts[link_from:])))
        text = squeeze("".join(parts))
        if text:
            blocks.append(Block(text, tuple(ids), tuple(names), linked, links))
        parts, linked, links = [], 0, 0
        if link_from is not None:
            link_from = 0

    at = 0
    for tag in TAG.finditer(body):
        start = tag.start()
        if start > at:
            parts.append(body[at:start])
        at = tag.end()
        name = tag[2]
        if name is None:
            flush()
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                if link_from is not None:
                    linked += len(squeeze("".join(parts[link_from:])))
                    link_from = None
                if not tag[1]:
                    link_from, links = len(parts), links + 1
            continue
        flush()
        if tag[1]:
            link_from = None if name in ("p", "li", "div", "td") else link_from
            if name in names:
                while names:
                    ids.pop()
                    if names.pop() == name:
                        break
        elif name not in VOID and not tag[3].endswith("/"):
            if name in CLOSES_P and names and names[-1] == "p":
                names.pop(), ids.pop()
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and names and names[-1] in (name, "p", "dt", "dd", "td", "th"):
                while names and names[-1] in ({"p", name} | ({"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th", "tr") else set())):
                    names.pop(), ids.pop()
            count += 1
            names.append(name)
            ids.append(count)
    if at < len(body):
        parts.append(body[at:])
    flush()
    return page


# --- what a site repeats ---------------------------------------------------------


def window_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix a number, the same for suffixes that agree in their first ``depth`` tokens (a power of two).

    Prefix doubling: the names of depth 2k are those of the pairs (name at i, name at i + k),
    mixed into 64 bits; they are ranked once, at the full depth.
    """
    name = tokens.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < depth:
        ahead = np.zeros(len(name), dtype=np.uint64)
        ahead[:-step] = name[step:]
        name = (name ^ (name >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ahead * np.uint64(0xBF58476D1CE4E5B9)
        step *= 2
    return np.unique(name, return_inverse=True)[1].astype(np.int64)


def distinct_owners(groups: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each element the number of distinct owners of its group."""
    if not len(groups):
        return groups
    pair = np.unique(groups * (owners.max() + 1) + owners)
    return np.bincount(pair // (owners.max() + 1), minlength=groups.max() + 1)[groups]


def page_owner(page: Page) -> str:
    """What distinct pages are told apart by: title, first h1 and the OWN_BLOCKS longest blocks without links.

    A repeated fetch or a mirror is the same page, though its menus, dates and numbers may
    differ; pages of one title with other texts are not. What only its characters beyond
    ASCII tell apart is the same page, decoded wrongly.
    """
    heading = next((b.text for b in page.blocks if "h1" in b.tags), "")
    longest = sorted({b.text for b in page.blocks if not b.links and BESIDE.isdisjoint(b.tags)}, key=lambda t: (-len(t), t))[:OWN_BLOCKS]
    parts = [page.title, heading, *sorted(DIGITS.sub("0", t) for t in longest)]
    return FOREIGN.sub("*", "\n".join(parts)) if page.blocks else repr(page.key)


@functools.lru_cache(1 << 16)
def word_count(text: str) -> int:
    return len(LETTERS.findall(text))


@functools.lru_cache(1 << 16)
def digest(text: str) -> int:
    """A number of 64 bits with sign for a text, the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def line_uses(page: Page, among: set[str] | None = None) -> dict[str, tuple[bool, bool]]:
    """The lines of a page that a count of pages can make boilerplate, with ``beside`` and ``item``.

    Left out are lines with links, and short or numeric ones, which pages share by chance.
    ``beside``: it stands in an aside, a menu or a footer. ``item``: it stands outside of
    these as a list's item, a cell, a quote or code, as only content does. ``among``: the lines
    to look at, where others are known not to come back.
    """
    out: dict[str, tuple[bool, bool]] = {}
    for b in page.blocks:
        if b.links or among is not None and b.text not in among or word_count(b.text) < ASIDE_WORDS:
            continue
        beside = not BESIDE.isdisjoint(b.tags)
        item = not beside and not ITEMS.isdisjoint(b.tags)
        was = out.get(b.text, (False, False))
        out[b.text] = (was[0] or beside, was[1] or item)
    return out


def is_long_line(text: str) -> bool:
    """Long enough, and without digits, to be boilerplate by PAGES alone."""
    return word_count(text) >= WORDS and not any(map(str.isdigit, text))


def boilerplate_lines(pages: list[Page], owners_of: list[str]) -> set[int]:
    """Digests of the lines of a whole site that stand on enough distinct pages of it; never more for a larger site."""
    owners: dict[str, set[str]] = {}
    marks: dict[str, tuple[bool, bool]] = {}
    seen = Counter(text for p in pages for text in {b.text for b in p.blocks if not b.links})
    again = {text for text, n in seen.items() if n >= ASIDE_PAGES}
    for p, owner in zip(pages, owners_of):
        for text, (beside, item) in line_uses(p, again).items():
            owners.setdefault(text, set()).add(owner)
            was = marks.get(text, (False, False))
            marks[text] = (was[0] or beside, was[1] or item)
    return {
        digest(text)
        for text, who in owners.items()
        if len(who) >= ASIDE_PAGES and not marks[text][1] and (marks[text][0] or len(who) >= PAGES and is_long_line(text))
    }


def repeated_blocks(pages: list[Page], share: float = SHARE, window: int = WINDOW) -> list[str]:
    """Mark the blocks of one site that are covered by substrings repeated across its pages; gives the pages' owners.

    Distinct pages are told apart by ``page_owner``. A substring counts as repeated if it
    stands on at least two pages and on ``share`` of them; a block is covered if it comes
    back as a whole, or if repeated substrings of ``window`` tokens cover at least nine
    tenths of it.
    """
    owners = [page_owner(p) for p in pages]
    if pages:
        _cover_repeats(pages, owners, share, window)
        _cover_garbled(pages, set())
    return owners


def cover_lines(pages: list[Page], owners: list[str], lines: set[int] | None = None) -> None:
    """Mark the boilerplate lines of the site besides, whatever share of its pages has them.

    ``lines`` are their digests where ``pages`` are only a part of the site; by default they
    are counted here.
    """
    if lines is None:
        lines = boilerplate_lines(pages, owners)
    if not lines:
        return
    verdicts: dict[str, bool] = {}
    for p in pages:
        for b in p.blocks:
            if not b.covered and not b.links:
                if b.text not in verdicts:
                    verdicts[b.text] = digest(b.text) in lines
                b.covered = verdicts[b.text]
    _cover_garbled(pages, {text for text, hit in verdicts.items() if hit and not ASCII_WORD.search(text)})


def _cover_repeats(pages: list[Page], owners_of: list[str], share: float, window: int) -> None:
    """Cover by share; see ``repeated_blocks``."""
    owner_of: dict[str, int] = {}
    owners = [owner_of.setdefault(o, len(owner_of)) for o in owners_of]
    least = max(2, int(np.ceil(share * len(owner_of))))
    blocks = [b for p in pages for b in p.blocks]
    if not blocks or len(owner_of) < 2:
        return
    block_owner = np.repeat(owners, [len(p.blocks) for p in pages]).astype(np.int64)

    ids: dict[str, int] = {}
    whole = np.fromiter((ids.setdefault(b.text, len(ids)) for b in blocks), np.int64, len(blocks))
    again = distinct_owners(whole, block_owner) >= least

    # each distinct text is cut once; a boundary token (0) stands before each block
    words: dict[str, int] = {"": 0}
    cut = [np.array([0, *(words.setdefault(t, len(words)) for t in TOKEN.findall(text))], dtype=np.int64) for text in ids]
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))[whole] - 1
    tokens = np.concatenate([cut[i] for i in whole.tolist()])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    token_owner = np.repeat(block_owner, lengths + 1)
    ranks = window_ranks(tokens, window)
    common = distinct_owners(ranks, token_owner) >= least
    # a window at the end of a page must not reach into the next one
    ends = np.flatnonzero(np.diff(np.repeat(np.arange(len(pages)), [int((lengths[a:b] + 1).sum()) for a, b in _spans(pages)]), append=-1))
    for back in range(window - 1):
        common[np.maximum(ends - back, 0)] = False
    run = np.zeros(len(tokens) + window, dtype=np.int64)
    run[: len(tokens)] += common
    run[window:] -= common
    covered = np.cumsum(run)[: len(tokens)] > 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    inside = sums[starts + lengths + 1] - sums[starts + 1]
    for block, one, two in zip(blocks, again, (inside >= 0.9 * lengths) & (lengths > 0)):
        block.covered = bool(one or two)


def _cover_garbled(pages: list[Page], shapeless: set[str]) -> None:
    """Cover blocks that differ from a covered one only in characters beyond ASCII.

    That is asked of blocks with garbled sequences, and of pages that have none of the
    site's covered text beyond ASCII, since a page decoded wrongly shares none of it.
    Texts in ``shapeless``, which have no ASCII word to be known by, don't count.
    """
    shapes = {FOREIGN.sub("*", b.text) for p in pages for b in p.blocks if b.covered and not b.text.isascii() and b.text not in shapeless}
    if not shapes:
        return
    for p in pages:
        strange = not any(b.covered and not b.text.isascii() and "\xa9" not in b.text for b in p.blocks)
        for b in p.blocks:
            if not b.covered and (strange or GARBLED.search(b.text)) and not b.text.isascii():
                b.covered = FOREIGN.sub("*", b.text) in shapes


def _spans(pages: list[Page]) -> list[tuple[int, int]]:
    at, out = 0, []
    for p in pages:
        out.append((at, at + len(p.blocks)))
        at += len(p.blocks)
    return out


# --- the page's own content ------------------------------------------------------

DATE = re.compile(r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b")
META = re.compile(r"^\d+\s+min\s+read\b|\b\d+\s+shares$|^by\s+[^.]{3,60}$", re.I)


def is_byline(text: str) -> bool:
    """Author, date and share-count lines: a few words with a date, or the usual forms."""
    return len(text) < 80 and (bool(DATE.search(text)) and len(text.split()) <= 8 or bool(META.search(text)))


def main_blocks(page: Page) -> list[Block]:
    """The blocks of the page's own content, in order: its heading and what follows it in its container.

    The container is the smallest element around the heading that holds more unique
    text than the heading. Within it covered blocks, bylines, asides and paragraphs
    made of links fall away; cells of tables stay although their words repeat.
    """
    blocks = page.blocks
    head = _heading(page)
    if head is None:
        return [b for b in blocks if not b.covered and not is_byline(b.text) and not _link_line(b, ()) and not b.links]
    where = blocks[head]
    own = lambda b, depth: _own(b, where.path[:depth])
    depth = len(where.path)
    for d in range(len(where.path) - 1, -1, -1):
        depth = d
        if where.tags[d - 1 : d] in (("p",), ("h1",)):
            continue
        rest = [b for b in blocks[head + 1 :] if b.path[:d] == where.path[:d]]
        if any(own(b, d) for b in rest):
            break
        if where.tags[d - 1 : d] in (("main",), ("article",), ("body",)):
            break
    return [where, *(b for b in blocks[head + 1 :] if b.path[:depth] == where.path[:depth] and own(b, depth))]


def _own(block: Block, container: tuple[int, ...]) -> bool:
    inner = block.tags[len(container) :]
    if "table" in inner:
        return True
    if block.covered or is_byline(block.text) or "aside" in inner or "nav" in inner or "footer" in inner or "section" in inner and block.links:
        return False
    return not _link_line(block, inner)


def _link_line(block: Block, inner: tuple[str, ...]) -> bool:
    """A line of links to other pages; an item of a list inside the content is none."""
    return block.links > 0 and block.linked >= 0.6 * len(block.text) and "li" not in inner


def _heading(page: Page) -> int | None:
    """The block that the page's title names, else its first h1, else its first unique h2."""
    title = page.title.rpartition(" | ")[0] or page.title
    firsts = [i for i, b in enumerate(page.blocks) if b.text == title and not b.links]
    for name in ("h1", "h2"):
        firsts += [i for i, b in enumerate(page.blocks) if name in b.tags and not b.covered]
    return firsts[0] if firsts else None
