"""Reading level of documents, on the scale of bands that people gave.

Every sentence gets a distribution over the levels from smoothed word and character
models; a document's difficulty is the mean of its sentences' distributions, calibrated
against the bands.

The models are additive: a sentence's score is the sum over its words of a weight for
the word and of weights for the character sequences in it. So a word's weight is worked
out once for each distinct word a worker meets, and a document costs one look-up a word.
Sentence levels are latent. They start at the band of the document and are re-estimated
in a few rounds (a document of band 3 holds easy sentences too); raters are weighted by
how far they agree with the others.

The models are fitted on at most ``MAX_LABELLED`` labelled documents, taken by a hash of
their id; all documents are scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BANDS = 4
MAX_LABELLED = 4000
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 14
GRAM = 4
SMOOTHING = 0.5
ROUNDS = 4
MIN_WORDS = 60

CUT = re.compile(r"(?<=[.!?])\s+|\n+|;\s+")
# Common English function words.
ENGLISH = frozenset("the of and to a in is that it for on with as by an this from at or be are was which when if".split())


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def features(token: str) -> tuple[int, list[int]]:
    """The buckets of a word and of the character sequences in it; digits count as one character class."""
    bare = re.sub(r"\d+", "0", token.strip(".,:;!?\"'()[]“”‘’-").lower())
    padded = f" {bare} "
    return crc(bare) % WORD_BUCKETS, [crc(padded[i : i + GRAM]) % CHAR_BUCKETS for i in range(max(1, len(padded) - GRAM + 1))]


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; lines end sentences."""
    return [w for s in CUT.split(text) if (w := s.split())]


def is_english(hits: float, words: int) -> bool:
    """At least 1 in 12 words is a common English function word."""
    return words > 0 and hits * 12 >= words


class Weights:
    """Weights of words by level, and whether a word is an English function word; pickled without its cache."""

    MOST = 400_000

    def __init__(self, words: np.ndarray, chars: np.ndarray):
        self.words, self.chars = words, chars
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, BANDS + 1))

    def __getstate__(self):
        return {"words": self.words, "chars": self.chars}

    def __setstate__(self, state):
        self.__init__(state["words"], state["chars"])

    def of(self, token: str) -> int:
        at = self.ids.get(token)
        if at is None:
            at = self.ids[token] = len(self.ids)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            word, grams = features(token)
            # characters count half: they overlap
            self.table[at, :BANDS] = self.words[word] + 0.5 * self.chars[grams].mean(axis=0)
            self.table[at, BANDS] = token.lower() in ENGLISH
        return at

    def rows(self, tokens: list[list[str]]) -> np.ndarray:
        """The row of each word of a document."""
        if len(self.ids) > self.MOST:
            self._clear()
        try:  # most words are known
            ids = self.ids
            at = [ids[w] for s in tokens for w in s]
        except KeyError:
            of = self.of
            at = [of(w) for s in tokens for w in s]
        return self.table[at]

    def levels(self, tokens: list[list[str]], rows: np.ndarray | None = None) -> np.ndarray:
        """A distribution over the levels for each sentence."""
        rows = self.rows(tokens) if rows is None else rows
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        sums = np.add.reduceat(rows[:, :BANDS], np.cumsum(lengths) - lengths, axis=0)
        # long sentences hold no more independent evidence than some dozen words
        sums *= (np.minimum(lengths, 12) / lengths)[:, None]
        sums -= sums.max(axis=1, keepdims=True)
        share = np.exp(sums)
        return share / share.sum(axis=1, keepdims=True)


def profile(levels: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A document as features: mean distributions over sentences and over words, and a constant."""
    return np.concatenate([levels.mean(axis=0), (levels * lengths[:, None]).sum(axis=0) / lengths.sum(), [1.0]])


class Reader:
    """Fitted model: sentence weights and one logistic calibration for each step from band to band."""

    def __init__(self, weights: Weights, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def bands(self, tokens: list[list[str]], rows: np.ndarray | None = None) -> np.ndarray:
        """The calibrated distribution over the bands."""
        lengths = np.fromiter(map(len, tokens), np.float64, len(tokens))
        x = profile(self.weights.levels(tokens, rows), lengths)
        above = np.minimum.accumulate(1 / (1 + np.exp(-np.clip(self.steps @ x, -30, 30))))
        return -np.diff(np.concatenate([[1.0], above, [0.0]]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(curve, gradient)
    return beta


def consensus(labels: list[tuple[int, str | None, int]]) -> dict[int, tuple[float, float]]:
    """``doc -> (band, weight)``: raters weighted by their agreement with the others; nulls fall away."""
    valid = [(d, r, b) for d, r, b in labels if b is not None and 1 <= b <= BANDS]
    by: dict[int, list[tuple[str | None, int]]] = {}
    for d, r, b in valid:
        by.setdefault(d, []).append((r, b))
    trust: dict[str | None, float] = {r: 1.0 for _, r, _ in valid}
    for _ in range(5):
        agree: dict[str | None, list[float]] = {r: [1.0, 1.0] for r in trust}
        for votes in by.values():
            for i, (r, b) in enumerate(votes):
                for j, (q, c) in enumerate(votes):
                    if i != j and r != q:
                        agree[r][0] += trust[q] * (b == c)
                        agree[r][1] += trust[q]
        trust = {r: a / n for r, (a, n) in agree.items()}
    out = {}
    for d, votes in by.items():
        r, b = max(votes, key=lambda v: trust[v[0]])
        out[d] = (b, trust[r] * (0.5 if len({x for _, x in votes}) > 1 else 1.0))
    return out


def fit(texts: dict[int, str], labels: list[tuple[int, str | None, int]], rounds: int = ROUNDS) -> Reader:
    """Fit on labelled texts. Without any usable label all levels are equally likely."""
    bands = {d: v for d, v in consensus(labels).items() if texts.get(d) and sentences(texts[d])}
    docs = sorted(bands)
    tokens = [sentences(texts[d]) for d in docs]
    cache: dict[str, tuple[int, list[int]]] = {}
    word_at, sent_of_word, gram_at, sent_of_gram, doc_of = [], [], [], [], []
    for i, doc in enumerate(tokens):
        for s in doc:
            k = len(doc_of)
            doc_of.append(i)
            for t in s:
                f = cache.get(t)
                if f is None:
                    f = cache[t] = features(t)
                word_at.append(f[0]), sent_of_word.append(k)
                gram_at += f[1]
                sent_of_gram += [k] * len(f[1])
    if not docs:
        return Reader(Weights(np.zeros((WORD_BUCKETS, BANDS)), np.zeros((CHAR_BUCKETS, BANDS))), np.zeros((BANDS - 1, 2 * BANDS + 1)))
    word_at, sent_of_word, gram_at, sent_of_gram, doc_of = map(np.asarray, (word_at, sent_of_word, gram_at, sent_of_gram, doc_of))
    band = np.array([bands[d][0] for d in docs])
    trust = np.array([bands[d][1] for d in docs])
    lengths = [np.fromiter(map(len, t), np.float64, len(t)) for t in tokens]
    distance = np.abs(np.arange(1, BANDS + 1)[None, :] - band[:, None])
    prior = np.array([1.0, 0.25, 0.1, 0.05])[distance]
    prior /= prior.sum(axis=1, keepdims=True)
    share = prior[doc_of]
    flat = [s for t in tokens for s in t]
    for _ in range(rounds):
        heavy = share * trust[doc_of][:, None]
        weights = Weights(_weights(word_at, heavy[sent_of_word], WORD_BUCKETS), _weights(gram_at, heavy[sent_of_gram], CHAR_BUCKETS))
        share = weights.levels(flat)
        likely = share * np.sqrt(prior[doc_of])
        share = likely / likely.sum(axis=1, keepdims=True)
    starts = np.cumsum([0, *map(len, tokens)])
    plain = weights.levels(flat)
    x = np.array([profile(plain[a:b], n) for a, b, n in zip(starts, starts[1:], lengths)])
    steps = np.array([logistic(x, (band > k).astype(float), trust) for k in range(1, BANDS)])
    return Reader(weights, steps)


def _weights(at: np.ndarray, share: np.ndarray, buckets: int) -> np.ndarray:
    """Smoothed log-probabilities of each bucket by level, less their mean."""
    counts = np.stack([np.bincount(at, weights=share[:, k], minlength=buckets) for k in range(BANDS)], axis=1)
    prior = counts.sum(axis=1, keepdims=True) / counts.sum()
    logp = np.log((counts + SMOOTHING * prior * BANDS + 1e-9) / (counts.sum(axis=0) + SMOOTHING * BANDS))
    logp[counts.sum(axis=1) == 0] = 0
    return logp - logp.mean(axis=1, keepdims=True)


def fitted(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Reader:
    """Fit on at most ``most`` labelled documents with a text, those of the smallest hash of their id."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("band").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows
    given = labels.join(F.broadcast(chosen), "doc_id").select("doc_id", "rater", "band")
    return fit({r[0]: r[1] for r in texts.collect()}, [tuple(r) for r in given.collect()])


def levels(documents: DataFrame, reader: Reader) -> DataFrame:
    """``doc_id, n_words, english, band, p1..p4, difficulty`` of each document.

    ``band`` is the likeliest band, ``difficulty`` the mean of the bands under the
    calibrated distribution. Null, empty and blank texts have no words, and null bands;
    rows with a null id are left out.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                tokens = sentences(text) if text else []
                if not tokens:
                    rows.append((doc, 0, False, None, None, None, None, None, None))
                    continue
                found = reader.weights.rows(tokens)
                p = reader.bands(tokens, found)
                rows.append((doc, len(found), is_english(found[:, BANDS].sum(), len(found)), int(np.argmax(p)) + 1, *map(float, p), float(p @ np.arange(1, BANDS + 1))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "english", "band", "p1", "p2", "p3", "p4", "difficulty"]).astype({"band": "Int32"})

    schema = "doc_id long, n_words long, english boolean, band int, p1 double, p2 double, p3 double, p4 double, difficulty double"
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(scan, schema)


def hardest(documents: DataFrame, reader: Reader, band: int = BANDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id`` of the English documents of at least ``min_words`` words that are on the whole of ``band``."""
    return levels(documents, reader).where(F.col("english") & (F.col("n_words") >= min_words) & (F.col("band") == band)).select("doc_id")
