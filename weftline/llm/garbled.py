"""Text read with a wrong encoding: found and repaired by expectation-maximisation.

What a reader sees is the author's text sent through an unknown *chain*: nothing went
wrong, or bytes of encoding Y were read as X, once or twice. The chain is latent. The
evidence is the words with characters beyond ASCII: undoing the right chain turns them
into words that look like the rest of the corpus. No record alone tells what the corpus
looks like, so evidence is pooled over all records:

* M-step: trigram counts of the words as repaired (a hashed table of ``BUCKETS``
  numbers, whatever the corpus) and, for each declared encoding and media type, how
  often each chain occurs;
* E-step: for each distinct word of each source the posterior of each chain.

The model has a bounded size, its counts cover all records. In the end each record gets
the posterior of its chains: for the text as a whole, and for each word, since only a
part of it may be garbled. A short garbled piece within intact quotation marks of an
otherwise intact text is an example, not a fault.
"""

from __future__ import annotations

import codecs
import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.functions.http import media_type
from weftline.session import materialise

BUCKETS = 1 << 18
ROUNDS = 2
UNSEEN = 1e-3
#: Log-odds from which on a word alone, and a record's words together, are held for garbled.
WORD_ODDS, RECORD_ODDS = 5.0, 8.0

MARKUP = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^<>]*>", re.S | re.I)
WORD = re.compile("[A-Za-z'’]*[^\x00-\x7f][A-Za-z'\x80-\U0010ffff]*")
NBSP = re.compile("(?<![\xc0-\xf4Ѐ-ӿĂ-ţͰ-Ͽ])\xa0")
EXAMPLE = re.compile("“[^“”\n]{1,60}”")
LOST = re.compile("�|ï¿½")


def _bytes_of(name: str) -> dict[int, str]:
    """For ``str.translate``: the characters that ``name`` reads from each byte beyond ASCII, to that byte as a character.

    Bytes that ``name`` leaves undefined are read as C1 controls, as browsers do.
    """
    table = {}
    for b in range(0x80, 0x100):
        try:
            char = bytes([b]).decode(name)
        except UnicodeDecodeError:
            char = chr(b)
        table[ord(char)] = chr(b)
        if b < 0xA0:
            table.setdefault(b, chr(b))
    return table


#: What text is wrongly read as, and what it was written in then.
MISREADINGS = {
    "windows-1252": ("utf-8", "windows-1250", "iso-8859-2", "windows-1251", "koi8-r", "windows-1253", "shift_jis", "euc_jp"),
    "windows-1250": ("utf-8", "windows-1252", "iso-8859-2"),
    "iso-8859-2": ("utf-8", "windows-1252", "windows-1250"),
    "windows-1251": ("utf-8", "windows-1252", "koi8-r"),
    "koi8-r": ("utf-8", "windows-1252", "windows-1251"),
    "windows-1253": ("utf-8", "windows-1252"),
}
TABLES = {name: _bytes_of(name) for name in MISREADINGS}
CHAINS = [(x, y) for x, ys in MISREADINGS.items() for y in ys]
NUMBERS = {c: i for i, c in enumerate(CHAINS, 1)}
NAMES = ["", *(f"{y}>{x}" for x, y in CHAINS), "utf-8>windows-1252 twice"]
CONTROL = re.compile("[\x7f-\x9f\ufffd]")


def undo(word: str, x: str, y: str) -> str | None:
    """What was written in ``y`` and read as ``x``; null if that can't be."""
    try:
        return word.translate(TABLES[x]).encode("latin-1").decode(y)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def repairs(word: str) -> list[tuple[int, str]]:
    """``(chain, text)`` for each chain that could have led to ``word``, the intact one first."""
    out = [(0, word)]
    for x, ys in MISREADINGS.items():
        try:
            raw = word.translate(TABLES[x]).encode("latin-1")
        except UnicodeEncodeError:
            continue
        for y in ys:
            try:
                text = raw.decode(y)
            except UnicodeDecodeError:
                continue
            if text != word and not CONTROL.search(text):
                out.append((NUMBERS[x, y], text))
    once = undo(word, "windows-1252", "utf-8")
    if once is not None and once != word:
        twice = undo(once, "windows-1252", "utf-8")
        if twice is not None and twice != once:
            out.append((len(NAMES) - 1, twice))
    return out


def trigrams(word: str) -> list[int]:
    padded = f"^{word}$"
    return [zlib.crc32(padded[i : i + 3].encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for i in range(len(padded) - 2)]


def source_of(label: str | None, media: str | None) -> str:
    """The declared encoding under its canonical name, with the media type: one of a bounded number of sources."""
    try:
        name = codecs.lookup(label or "utf-8").name
    except LookupError:
        name = "unknown"
    kind = media if media in ("text/html", "text/plain", "application/json") else "other"
    return f"{name} {kind}"


def read(body: bytes, label: str | None) -> str:
    """The body as a reader of the label sees it: U+FFFD for what can't be decoded; an unknown label means UTF-8."""
    try:
        codec = codecs.lookup(label or "utf-8").name
    except LookupError:
        codec = "utf-8"
    if codec == "ascii":
        codec = "cp1252"
    return body.decode(codec, "replace")


def visible(text: str) -> str:
    """The text without markup, references resolved."""
    if "<" in text:
        text = MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text


def foreign_words(text: str) -> list[str]:
    return [] if text.isascii() else WORD.findall(NBSP.sub(" ", text))


class Model:
    """Trigram log-probabilities and the chains' log-priors by source."""

    def __init__(self, counts: np.ndarray, chains: dict[str, np.ndarray]):
        # a trigram that was never seen must cost more than several common ones: chains change the number of characters
        self.logp = np.log((counts + UNSEEN) / (float(counts.sum()) + UNSEEN * BUCKETS)).astype(np.float32)
        every = sum(chains.values(), np.zeros(len(NAMES)))
        base = (every + 0.01) / (every.sum() + 0.01 * len(NAMES))
        base[0] = max(base[0], 0.5)
        strength = 50.0
        self.priors = {s: np.log((c + strength * base) / (c.sum() + strength * base.sum())) for s, c in chains.items()}
        self.base = np.log(base / base.sum())
        self.cache: dict[str, list[tuple[int, str, float]]] = {}

    def likelihoods(self, word: str) -> list[tuple[int, str, float]]:
        """``(chain, text, log-likelihood)`` of a word's repairs."""
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            known = self.cache[word] = [(c, t, float(self.logp[trigrams(t)].sum())) for c, t in repairs(word)]
        return known

    def prior(self, source: str) -> np.ndarray:
        return self.priors.get(source, self.base)


class Pooled:
    """Sums over all records: what an M-step needs."""

    def __init__(self):
        self.counts: Counter[int] = Counter()
        self.chains: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(NAMES)))

    def add(self, word: str, source: str, weight: float, model: Model | None) -> None:
        if model is None:
            shares = [(0, word, 1.0)]
        else:
            found = model.likelihoods(word)
            if len(found) == 1:
                shares = [(0, word, 1.0)]
            else:
                prior = model.prior(source)
                score = np.array([l + prior[c] for c, _, l in found])
                share = np.exp(score - score.max())
                share /= share.sum()
                shares = [(c, t, float(p)) for (c, t, _), p in zip(found, share) if p > 1e-3]
        for c, t, p in shares:
            self.chains[source][c] += weight * p
            for g in trigrams(t):
                self.counts[g] += weight * p


def fit(words: DataFrame, rounds: int = ROUNDS) -> Model:
    """EM over ``word, source, n``. The driver gets at most ``BUCKETS`` sums and those of the sources' chains."""
    model: Model | None = None
    for _ in range(rounds + 1):
        now = model

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pooled = Pooled()
            for pdf in batches:
                for w, s, n in zip(pdf["word"], pdf["source"], pdf["n"]):
                    pooled.add(w, s, float(n), now)
            rows = [("", g, x) for g, x in pooled.counts.items()]
            rows += [(s, c, float(x)) for s, v in pooled.chains.items() for c, x in enumerate(v) if x]
            yield pd.DataFrame(rows, columns=["source", "key", "total"])

        sums = words.mapInPandas(step, "source string, key int, total double").groupBy("source", "key").agg(F.sum("total").alias("total")).toPandas()
        counts = np.zeros(BUCKETS)
        grams = sums[sums["source"] == ""]
        counts[grams["key"].to_numpy(int)] = grams["total"].to_numpy()
        chains: dict[str, np.ndarray] = {}
        for s, c, x in sums[sums["source"] != ""].itertuples(index=False):
            chains.setdefault(s, np.zeros(len(NAMES)))[c] = x
        model = Model(counts, chains)
    return model


def judge(body: bytes | None, label: str | None, media: str | None, model: Model) -> tuple[bool, list[int]]:
    """Whether the record is garbled, and its chains from the likeliest on."""
    if not body:
        return False, []
    if label is None or codecs_utf8(label):
        if body.isascii() and b"&" not in body:
            return False, []
    text = visible(read(body, label))
    if text.isascii():
        return False, []
    source = source_of(label, media)
    prior = model.prior(source)
    shown = " ".join(EXAMPLE.findall(text))
    rest = EXAMPLE.sub(lambda m: m[0] if len(m[0]) > 40 else " ", text)
    if LOST.search(rest):
        return True, []
    whole: dict[int, float] = defaultdict(float)
    worst = 0.0
    for word in foreign_words(rest) + ([] if shown.isascii() else [w for w in foreign_words(shown) if len(w) > 24]):
        found = model.likelihoods(word)
        if len(found) == 1:
            continue
        intact = found[0][2]
        for c, _, l in found[1:]:
            gain = l - intact
            whole[c] += gain
            worst = max(worst, gain + float(prior[c] - prior[0]))
    odds = {c: g + float(prior[c] - prior[0]) for c, g in whole.items()}
    order = sorted(odds, key=odds.get, reverse=True)
    return worst > WORD_ODDS or bool(order) and odds[order[0]] > RECORD_ODDS, [c for c in order if odds[c] > 0]


def codecs_utf8(label: str) -> bool:
    return label.lower().replace("-", "").replace("_", "") in ("utf8", "ascii", "usascii")


def repaired(body: bytes, label: str | None, media: str | None, model: Model) -> str:
    """The record's text (markup kept) as far as it can be recovered.

    A body that its label can't read, or that is UTF-8 under another label, is read anew:
    as UTF-8 if it is that, else by the encoding whose words are likeliest. Then each word
    takes its likeliest repair. Characters that were lost stay lost.
    """
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError:
        names = [label or "utf-8", *TABLES]
        texts = [read(body, n) for n in names]
        words = [foreign_words(visible(t)) for t in texts]
        scores = [sum(model.likelihoods(w)[0][2] for w in ws) - 1e3 * t.count("�") for ws, t in zip(words, texts)]
        text = texts[int(np.argmax(scores))]
    prior = model.prior(source_of("utf-8", media))
    inside = [m.span() for m in EXAMPLE.finditer(text) if len(m[0]) <= 40]

    def best(match: re.Match) -> str:
        if any(a <= match.start() < b for a, b in inside):
            return match[0]
        found = model.likelihoods(match[0])
        chain, fixed, _ = max(found, key=lambda f: f[2] + prior[f[0]])
        return fixed if chain else match[0]

    return WORD.sub(best, text)


def garbled_words(records: DataFrame) -> DataFrame:
    """``word, source, n``: the words beyond ASCII of all records and in how many records each stands."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter[tuple[str, str]] = Counter()
            for body, label, media in zip(pdf["body"], pdf["encoding"], pdf["media"]):
                if not body or body.isascii() and b"&" not in body:
                    continue
                source = source_of(label, media)
                found.update((w.replace("\x00", ""), source) for w in set(foreign_words(visible(read(body, label)))))
            yield pd.DataFrame([(w, s, n) for (w, s), n in found.items()], columns=["word", "source", "n"])

    counts = records.mapInPandas(scan, "word string, source string, n long")
    return counts.groupBy("word", "source").agg(F.sum("n").alias("n"))


def records_of(responses: DataFrame) -> DataFrame:
    return responses.where(F.col("response_id").isNotNull()).select("response_id", "encoding", media_type(F.col("headers")).alias("media"), "body")


def fitted(responses: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of all responses."""
    return fit(materialise(garbled_words(records_of(responses)), "foreign-words"), rounds)


def garbled_responses(responses: DataFrame, model: Model | None = None) -> DataFrame:
    """``response_id`` of the responses whose text is garbled, in all or in part.

    Null and empty bodies and texts in plain ASCII are no cases, whatever their label.
    An unknown label is taken for UTF-8. Rows with a null id are left out.
    """
    model = model or fitted(responses)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = [judge(b, e, m, model)[0] for b, e, m in zip(pdf["body"], pdf["encoding"], pdf["media"])]
            yield pdf.loc[hit, ["response_id"]]

    return records_of(responses).mapInPandas(scan, "response_id long")


def repaired_responses(responses: DataFrame, model: Model | None = None) -> DataFrame:
    """``response_id, chain, text`` of the garbled responses: the likeliest chain (null if characters were lost) and the repaired text."""
    model = model or fitted(responses)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, body, label, media in zip(pdf["response_id"], pdf["body"], pdf["encoding"], pdf["media"]):
                hit, chains = judge(body, label, media, model)
                if hit:
                    rows.append((i, NAMES[chains[0]] if chains else None, repaired(body, label, media, model).replace("\x00", "")))
            yield pd.DataFrame(rows, columns=["response_id", "chain", "text"])

    return records_of(responses).mapInPandas(scan, "response_id long, chain string, text string")
