"""Template residue and error pages, by expectation-maximisation over aligned pages.

The pages of a site are aligned by what they share (see ``pages``): that is the frame of
its template, and what is left of a page are its slots, the content. Which content is
residue nobody says in words. Three things do, over all sites together:

* slots that retain a variable in the syntax of a template language;
* whole contents that come back, digits and addresses aside, as one page does on several
  sites, and are short: an error page if error statuses go with them or many sites show it;
* an error status, which is weak evidence, since statuses often don't fit the body.

From these seeds a latent class is estimated: for each word and pair of words, how often
pages of residue have it and how often others have it (M-step), and for each page which of
its sentences are made of the words of residue (E-step). So filler, messages, script
defaults and demands for scripts are learned from the corpus, in whatever language it has
them. A page is a case if more than half of its content's characters are in such sentences
or in slots.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.http import media_type
from weftline.llm.lines import site_of
from weftline.llm.pages import ASIDE_PAGES, PAGES, Page, cover_lines, digest, is_long_line, line_uses, main_blocks, page_blocks, page_owner, repeated_blocks, squeeze
from weftline.session import materialise

# The ways template languages write a variable.
NAME = r"\s*[A-Za-z_][\w]*(?:[.\-][\w]+)*(?:\s*\|\s*\w+)?\s*"
SLOT = re.compile(
    rf"\{{\{{\{{?{NAME}\}}?\}}\}}|[$#]?\{{{NAME}\}}|\{{%{NAME}%\}}|<%=?{NAME}%>|@@{NAME}@@|%%{NAME}%%|\*\|{NAME}\|\*|\[\[{NAME}\]\]"
    rf"|\b__[A-Za-z][\w.]*?__(?!\w)|\[(?:INSERT|ENTER|ADD|YOUR)\b[^\]]{{0,60}}\]|\[PLACEHOLDER[^\]]{{0,40}}\]|%[A-Z_]{{3,}}%"
)
SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]*\s*")
WORD = re.compile(r"[^\W\d_]+|\d+")
#: Stands for each character of a slot: of the private use area, no word.
HOLE = "\ue000"

#: Words and pairs of words are counted in so many places, whatever the corpus.
BUCKETS = 1 << 20
ROUNDS = 2
#: A whole content is a seed if it is at most so long and stands on so many sites: SITES with the share ERRORS of error statuses, MANY_SITES without.
SHORT, SITES, MANY_SITES, ERRORS = 400, 3, 6, 0.2
#: Mean log-odds of its words from which on a sentence is residue; those of one word are held within ODDS.
LEAST, ODDS = 0.5, 4.0
SMOOTHING = 0.5
#: Probabilities of the seeds: slots in much of the content, slots at all, a seeded template, an error status above a short content, anything else.
SEEDS = (0.95, 0.5, 0.9, 0.3, 0.01)

BLOCK_PAGES = 1000
#: Up to so many rows of two short strings a side is broadcast; beyond it is joined by shuffle.
BROADCAST_ROWS = 100_000


# --- contents as features ----------------------------------------------------------


_WORDS: dict[str, tuple[int, ...]] = {}


def word_hashes(word: str) -> tuple[int, ...]:
    """One number for a word, any number being one word; scripts without spaces are cut into three characters."""
    found = _WORDS.get(word)
    if found is None:
        if len(_WORDS) > 400_000:
            _WORDS.clear()
        parts = ["0"] if word[0].isdigit() else [word[i : i + 3] for i in range(len(word) - 2)] if len(word) > 5 and word[0] > "\u2e80" else [word]
        found = _WORDS[word] = tuple(zlib.crc32(x.encode("utf-8", "replace")) for x in parts)
    return found


def features(sentence: str) -> list[int]:
    """The places of a sentence's words and pairs of neighbouring words, the sentence's ends being words."""
    words = [h for w in WORD.findall(sentence.lower()) for h in word_hashes(w)]
    if not words:
        return []
    pairs = [(a * 0x9E3779B1 + b * 0x85EBCA77 >> 11) & (BUCKETS - 1) for a, b in zip([1, *words], [*words, 2])]
    return [h & (BUCKETS - 1) for h in words] + pairs


FEATURES = "size int, slots int, lengths binary, slot_chars binary, counts binary, places binary"


def content_features(texts: list[str]) -> tuple[int, int, bytes, bytes, bytes, bytes]:
    """A content as numbers: its characters and those in slots, and for each sentence characters, slot characters, features and their places.

    The first time a page has a feature its place stands as it is, later as its complement.
    """
    lengths, slots, counts, places, seen = [], [], [], [], set()
    for text in texts:
        if any(c in text for c in "{%@*[_"):
            text = SLOT.sub(lambda m: HOLE * len(m[0]), text)
        for s in SENTENCE.findall(text) or [text]:
            found = features(s)
            lengths.append(len(s)), slots.append(s.count(HOLE)), counts.append(len(found))
            for f in found:
                places.append(~f if f in seen else f)
                seen.add(f)
    pack = lambda x: np.array(x, dtype=np.int32).tobytes()
    return sum(lengths), sum(slots), pack(lengths), pack(slots), pack(counts), pack(places)


def residue_chars(lengths: np.ndarray, slots: np.ndarray, counts: np.ndarray, places: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """How many characters of each sentence are residue."""
    value = np.concatenate([[0.0], np.cumsum(odds[np.where(places < 0, ~places, places)], dtype=np.float64)])
    ends = np.cumsum(counts)
    mean = (value[ends] - value[ends - counts]) / np.maximum(counts, 1)
    whole = np.where(counts > 0, (mean > LEAST) & (lengths > slots), slots > 0)
    return np.where(whole, lengths, slots)


class Batch:
    """The features of the pages of a batch, put together."""

    def __init__(self, pdf: pd.DataFrame):
        read = lambda c: np.frombuffer(b"".join(pdf[c]), dtype=np.int32)
        self.lengths, self.slots, self.counts, self.places = map(read, ("lengths", "slot_chars", "counts", "places"))
        self.sentences = np.fromiter((len(x) // 4 for x in pdf["lengths"]), np.int64, len(pdf))
        self.features = np.fromiter((len(x) // 4 for x in pdf["places"]), np.int64, len(pdf))
        self.size = np.maximum(pdf["size"].to_numpy(np.float64), 1)

    def shares(self, odds: np.ndarray) -> np.ndarray:
        """The share of residue in each page's content."""
        chars = np.concatenate([[0], np.cumsum(residue_chars(self.lengths, self.slots, self.counts, self.places, odds))])
        ends = np.cumsum(self.sentences)
        return (chars[ends] - chars[ends - self.sentences]) / self.size


def fit(contents: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """EM over contents with ``seed``: log-odds by place. The driver gets at most ``BUCKETS`` sums."""
    odds: np.ndarray | None = None
    spark = contents.sparkSession
    for _ in range(rounds):
        sent = None if odds is None else spark.sparkContext.broadcast(odds)

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, pages, touched = np.zeros((2, BUCKETS)), np.zeros(2), False
            for pdf in batches:
                if not len(pdf):
                    continue
                batch, touched = Batch(pdf), True
                chance = pdf["seed"].to_numpy(np.float64) if sent is None else np.clip(1 / (1 + np.exp(-12 * (batch.shares(sent.value) - 0.5))), 0.005, 0.995)
                first = batch.places >= 0
                places, weight = batch.places[first], np.repeat(chance, batch.features)[first]
                sums[0] += np.bincount(places, weights=weight, minlength=BUCKETS)
                sums[1] += np.bincount(places, weights=1 - weight, minlength=BUCKETS)
                pages += chance.sum(), (1 - chance).sum()
            if touched:
                at = np.flatnonzero(sums.sum(axis=0))
                yield pd.DataFrame({"place": np.append(at, -1).astype(np.int32), "residue": np.append(sums[0, at], pages[0]), "other": np.append(sums[1, at], pages[1])})

        read = contents.select("seed", "size", "lengths", "slot_chars", "counts", "places")
        total = read.mapInPandas(step, "place int, residue double, other double").groupBy("place").agg(F.sum("residue").alias("residue"), F.sum("other").alias("other"))
        rows = total.where((F.col("residue") + F.col("other") >= 1.5) | (F.col("place") < 0)).toArrow()
        place, residue, other = (rows[c].to_numpy() for c in ("place", "residue", "other"))
        pages = place < 0
        n1, n0 = (residue[pages][0], other[pages][0]) if pages.any() else (0.0, 0.0)
        odds = np.zeros(BUCKETS, dtype=np.float32)  # rare features say nothing
        own = ~pages
        # drawn to the rate of all pages: what both classes have alike, and a class without evidence, say nothing
        rate = SMOOTHING * (residue[own] + other[own]) / max(n1 + n0, 1e-9)
        odds[place[own]] = np.clip(np.log((residue[own] + rate) / (n1 + SMOOTHING)) - np.log((other[own] + rate) / (n0 + SMOOTHING)), -ODDS, ODDS)
    return odds


def with_seeds(contents: DataFrame) -> DataFrame:
    """Adds ``seed``, the probability of residue before any word was looked at."""
    error = F.coalesce(F.col("status") >= 400, F.lit(False))
    short = F.col("size") <= SHORT
    by_site = contents.where(F.col("template").isNotNull() & short).groupBy("template", "site").agg(F.count("*").alias("pages"), F.count_if(error).alias("errors"))
    counted = by_site.groupBy("template").agg(F.count("*").alias("sites"), F.sum("pages").alias("pages"), F.sum("errors").alias("errors"))
    templates = materialise(counted.where((F.col("sites") >= MANY_SITES) | (F.col("sites") >= SITES) & (F.col("errors") >= ERRORS * F.col("pages"))).select("template", F.lit(True).alias("_again")), "templates")
    if templates.count() <= BROADCAST_ROWS:
        templates = F.broadcast(templates)
    much, some, again, failed, none = map(F.lit, SEEDS)
    by_slots = F.when(F.col("slots") > 0.3 * F.col("size"), much).when(F.col("slots") > 0, some).otherwise(none)
    seed = F.greatest(by_slots, F.when(F.coalesce("_again", F.lit(False)), again).otherwise(none), F.when(error & short, failed).otherwise(none))
    return contents.join(templates, "template", "left").withColumn("seed", seed).drop("_again")


def with_cases(contents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``contents`` with ``residue``: more than half of the content is residue. Pages without content are none."""
    seeded = with_seeds(contents)
    sent = contents.sparkSession.sparkContext.broadcast(fit(seeded, rounds))
    kept = [c for c in contents.columns if c not in ("lengths", "slot_chars", "counts", "places")]
    types = dict(contents.dtypes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[kept].assign(residue=Batch(pdf).shares(sent.value) > 0.5 if len(pdf) else False)

    return contents.mapInPandas(scan, ", ".join(f"{c} {types[c]}" for c in kept) + ", residue boolean")


def template_key(texts: list[str], host: str = "") -> str:
    """The content with digits, hosts and paths left out, which an error template repeats from site to site."""
    text = " | ".join(texts).replace(host, "*") if host else " | ".join(texts)
    return re.sub(r"\d+", "0", re.sub(r"\S*[/.]\S*[/.]\S*", "*", text))


def content_blocks(page: Page) -> list[str]:
    """The texts of a page's content; of its noscript elements if it shows nothing else."""
    texts = [b.text for b in main_blocks(page)]
    if not texts and page.noscript and not any(not b.covered and not b.links for b in page.blocks):
        texts = [page.noscript]
    return texts


def template_hash(texts: list[str], url: str | None) -> str | None:
    return hashlib.md5(template_key(texts, _host(url)).encode("utf-8", "replace")).hexdigest() if texts else None


def _host(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def json_texts(source: str) -> list[str]:
    """Strings of a JSON response, with the names of members that speak of errors; none if it isn't JSON."""
    try:
        value = json.loads(source)
    except (ValueError, RecursionError):
        return [squeeze(source)] if source.strip() else []
    out: list[str] = []
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo += reversed(v.values())
        elif isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, str) and v:
            out.append(v)
    return out


def json_reports_error(source: str) -> bool:
    """A JSON response without items of its own whose members say that it failed."""
    try:
        value = json.loads(source)
    except (ValueError, RecursionError):
        return False
    if not isinstance(value, dict):
        return False
    items = [v for v in value.values() if isinstance(v, list) and any(isinstance(x, dict) for x in v)]
    failed = value.get("error") or value.get("errors") or str(value.get("status", "")).lower() in ("error", "fail", "failed") or value.get("success") is False or value.get("ok") is False
    data = [k for k, v in value.items() if k not in ("error", "errors", "message", "status", "detail", "code", "success", "ok") and v not in (None, "", [], {})]
    return bool(failed) and not data and not [v for v in items if v is not value.get("errors")]


# --- sites of pages, as tables ---------------------------------------------------


def title_name(body: Column) -> Column:
    """What a page's title says after its last bar, in lower case; empty without one."""
    return F.lower(F.regexp_extract(body.cast("string"), r"(?is)<title[^>]*>[^<]*\|\s*([^<|]+?)\s*</title", 1))


def response_pages(responses: DataFrame) -> DataFrame:
    """``origin, page_key, url, status, encoding, body`` of the HTML responses with a body."""
    html_ = responses.where(F.col("response_id").isNotNull() & (media_type(F.col("headers")) == "text/html") & (F.octet_length("body") > 0))
    return html_.select(F.lit("responses").alias("origin"), F.col("response_id").cast("string").alias("page_key"), "url", status_of(responses), "encoding", "body")


def status_of(table: DataFrame) -> Column:
    """The HTTP status; null where the table has none."""
    return (F.col("status") if "status" in table.columns else F.lit(None)).cast("int").alias("status")


def from_base64(text: Column) -> Column:
    """Bytes of base64 in either alphabet, wrapped or not, with or without padding; null if it is none."""
    plain = F.translate(F.regexp_replace(text, r"[\s=]+", ""), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    return F.when(plain.rlike("^[A-Za-z0-9+/]+$") & (F.length(plain) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))


def cached_pages(cached: DataFrame) -> DataFrame:
    html_ = cached.where(F.col("fingerprint").isNotNull() & (media_type(F.col("headers")) == "text/html"))
    pages = html_.select(F.lit("cached_responses").alias("origin"), F.col("fingerprint").alias("page_key"), "url", status_of(cached), "encoding", from_base64(F.col("content_base64")).alias("body"))
    return pages.where(F.octet_length("body") > 0)


def with_site(pages: DataFrame) -> DataFrame:
    """Adds ``site``: the host, without ``www.``; for pages of a mirror the host they were copied from.

    A host's name is what at least half of its titles end with. A host without a name that
    carries pages of a name that exactly one other host has is a mirror for those.
    """
    # written once: the name is read from the whole body, and the pages are gone through three times
    named = materialise(pages.withColumns({"_host": F.coalesce(site_of(F.col("url")), F.lit("")), "_name": title_name(F.col("body"))}), "site-pages")
    uses = named.groupBy("_host", "_name").agg(F.count("*").alias("n"))
    hosts = uses.groupBy("_host").agg(F.sum("n").alias("all"), F.max(F.struct("n", "_name")).alias("m")).where((F.col("m.n") * 2 >= F.col("all")) & (F.col("m._name") != "")).select("_host", F.col("m._name").alias("_own"))
    hosts = materialise(hosts, "host-names")
    owners = hosts.groupBy(F.col("_own").alias("_name")).agg(F.count("*").alias("c"), F.min("_host").alias("_from")).where("c = 1").select("_name", "_from")
    if hosts.count() <= BROADCAST_ROWS:
        hosts, owners = F.broadcast(hosts), F.broadcast(owners)
    joined = named.join(hosts, "_host", "left").join(owners, "_name", "left")
    return joined.withColumn("site", F.when(F.col("_own").isNull() & F.col("_from").isNotNull(), F.col("_from")).otherwise(F.col("_host"))).drop("_host", "_name", "_own", "_from")


def by_site(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Adds ``site``, ``parts`` and ``unit``: sites of more than ``block_pages`` pages are dealt into parts by page, small sites put together.

    What a site repeats on a share of its pages stands in each part on about that share; lines
    that are repeated by count are counted over all parts (``site_lines``). No task gets
    more than one unit, of about ``block_pages`` pages. ``parts`` is null for a site of one part.
    """
    pages = with_site(pages)
    sizes = materialise(pages.groupBy("site").count(), "site-sizes")
    large = materialise(sizes.where(F.col("count") > block_pages).select("site", F.ceil(F.col("count") / block_pages).cast("int").alias("parts")), "large-sites")
    units = max(1, int((sizes.agg(F.sum("count")).first()[0] or 0) // block_pages))
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    part = F.pmod(F.xxhash64("page_key"), F.col("parts")).cast("string")
    unit = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("site"), F.lit(units)).cast("string")).otherwise(F.concat("site", F.lit("#"), part))
    return pages.join(large, "site", "left").withColumn("unit", unit)


def decoded(body: bytes, encoding: str | None) -> str:
    """As UTF-8 if it is that, else by the label, else by windows-1252."""
    for name in ("utf-8", encoding or "windows-1252"):
        try:
            return body.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("windows-1252", "replace")


def site_lines(dealt: DataFrame) -> DataFrame:
    """``of_unit, line``: for each part of the sites of several parts, the digests of the site's boilerplate lines.

    Pages are counted once for each site and line over all parts, by plain sums over
    distinct (site, line, page) rows; see ``pages.boilerplate_lines`` for sites of one part.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for site, parts, body, encoding, key in zip(pdf["site"], pdf["parts"], pdf["body"], pdf["encoding"], pdf["page_key"]):
                page = page_blocks(decoded(body, encoding), (key,))
                owner = digest(page_owner(page))
                rows += [(site, parts, digest(text), owner, beside, item, is_long_line(text)) for text, (beside, item) in line_uses(page).items()]
            yield pd.DataFrame(rows, columns=["site", "parts", "line", "owner", "beside", "item", "long"])

    several = dealt.where(F.col("parts") > 1).select("site", "parts", "body", "encoding", "page_key")
    uses = several.mapInPandas(scan, "site string, parts int, line long, owner long, beside boolean, item boolean, long boolean")
    counted = (
        uses.groupBy("site", "parts", "line", "owner")
        .agg(F.bool_or("beside").alias("beside"), F.bool_or("item").alias("item"), F.bool_or("long").alias("long"))
        .groupBy("site", "parts", "line")
        .agg(F.count("*").alias("pages"), F.bool_or("beside").alias("beside"), F.bool_or("item").alias("item"), F.bool_or("long").alias("long"))
    )
    lines = counted.where((F.col("pages") >= ASIDE_PAGES) & ~F.col("item") & (F.col("beside") | (F.col("pages") >= PAGES) & F.col("long")))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    return lines.select("site", "line", part).select(F.concat("site", F.lit("#"), F.col("part").cast("string")).alias("of_unit"), "line")


CONTENT = f"origin string, page_key string, site string, status int, template string, blocks array<string>, {FEATURES}"


def contents(pages: DataFrame, block_pages: int = BLOCK_PAGES, with_blocks: bool = True) -> DataFrame:
    """``origin, page_key, site, status, template, blocks`` and the features of each page's content.

    Without ``with_blocks`` the blocks are left empty, and lines aren't counted, which only they need.

    ``template`` is a hash of the content with digits, hosts and paths left out, ``blocks`` has the
    MD5 of each main block. The lines that a site repeats by count are no main blocks, but
    stay in the features: a placeholder is looked for however often its site shows it. Pages are
    read as UTF-8 where they are that.
    """

    def site_rows(pdf: pd.DataFrame, lines: set[int] | None) -> list[tuple]:
        parsed = [page_blocks(decoded(b, e), (k,)) for b, e, k in zip(pdf["body"], pdf["encoding"], pdf["page_key"])]
        owners = repeated_blocks(parsed)
        texts = [content_blocks(p) for p in parsed]
        if with_blocks:
            cover_lines(parsed, owners, lines)
        rows = []
        for page, own, origin, key, site, status, url in zip(parsed, texts, pdf["origin"], pdf["page_key"], pdf["site"], pdf["status"], pdf["url"]):
            blocks = [hashlib.md5(t.encode("utf-8", "replace")).hexdigest() for t in dict.fromkeys(content_blocks(page))] if with_blocks else []
            rows.append((origin, key, site, status if pd.notna(status) else None, template_hash(own, url), blocks, *content_features(own)))
        return rows

    def one(pdf: pd.DataFrame, lines: set[int] | None = None) -> pd.DataFrame:
        rows: list[tuple] = []
        for _, part in pdf.groupby("site", sort=False):
            rows += site_rows(part, lines if pd.notna(part["parts"].iloc[0]) else None)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CONTENT.split(", ")]).astype({"status": "Int32"})

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        return one(pdf)

    def with_lines(pdf: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        return one(pdf, set(lines["line"]))

    dealt = by_site(pages, block_pages)
    if not with_blocks:
        return dealt.groupBy("unit").applyInPandas(alone, CONTENT)
    return dealt.groupBy("unit").cogroup(site_lines(dealt).groupBy("of_unit")).applyInPandas(with_lines, CONTENT)


def json_contents(responses: DataFrame) -> DataFrame:
    """The same of JSON responses, whose content are their strings; ``blocks`` is empty. Adds ``failed``."""
    apis = responses.where(F.col("response_id").isNotNull() & (media_type(F.col("headers")) == "application/json") & (F.octet_length("body") > 0))
    read = apis.select(F.col("response_id").cast("string").alias("page_key"), F.coalesce(site_of(F.col("url")), F.lit("")).alias("site"), "url", status_of(responses), "encoding", "body")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, site, url, status, encoding, body in pdf.itertuples(index=False):
                source = decoded(body, encoding)
                texts = json_texts(source)
                rows.append(("responses", key, site, status if pd.notna(status) else None, template_hash(texts, url), [], *content_features(texts), json_reports_error(source)))
            yield pd.DataFrame(rows, columns=[*[c.split()[0] for c in CONTENT.split(", ")], "failed"]).astype({"status": "Int32"})

    return read.mapInPandas(scan, CONTENT + ", failed boolean")


def residue_responses(responses: DataFrame) -> DataFrame:
    """``response_id`` of the responses whose content is template residue or an error message.

    HTML by the contents of their sites' pages, JSON by its strings, and by members that say
    it failed where there is nothing else. Responses with other or no content type, with empty
    or null bodies or null ids, and pages without any content are no cases.
    """
    pages = contents(response_pages(responses), with_blocks=False).withColumn("failed", F.lit(False))
    found = materialise(pages.unionByName(json_contents(responses)).drop("blocks"), "contents")
    return with_cases(found).where(F.col("residue") | F.col("failed")).select(F.col("page_key").cast("long").alias("response_id"))


def main_content(responses: DataFrame, cached: DataFrame) -> DataFrame:
    """``origin, page_key, block_md5``: the main blocks of all HTML pages that are valid UTF-8, without error pages and residue."""
    pages = response_pages(responses).unionByName(cached_pages(cached)).where(F.is_valid_utf8(F.col("body").cast("string")))
    found = materialise(contents(pages), "contents")
    clean = with_cases(found).where(~F.col("residue"))
    return clean.select("origin", "page_key", F.explode(F.array_distinct("blocks")).alias("block_md5"))
