"""Has this key been seen before: a partitioned quotient filter over key hashes.

A key's hash is cut into a *quotient* (its leading bits) and a *remainder* (the
bits after them). The quotient is never stored: it follows from the place of a
remainder. The leading bits of the quotient name a *block*; each block is one row

    block long, n int, occupied binary, run_ends binary, remainders binary

where ``occupied`` has one bit for each quotient of the block, ``run_ends`` one bit
for each remainder (1 closes the run of a quotient) and ``remainders`` holds the
sorted remainders of all runs, four bytes each. That is ``remainder_bits + 2/load``
bits a key. Filters are sorted, so merging two of them is a merge of sorted runs.

A filter answers "certainly new" or "maybe seen". It never calls a seen key new;
it calls a new key seen if another key has the same quotient and remainder, which
for ``n`` stored keys has the probability ``1 - (1 - 2**-bits)**n``, about
``n * 2**-bits`` with ``bits`` hash bits in all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.operators.crawl import fingerprint as request_fingerprint
from weftline.session import materialise

REMAINDER_BITS = 32
KEYS_PER_BLOCK = 1 << 16
FILTER_SCHEMA = "block long, n int, occupied binary, run_ends binary, remainders binary"


# --- the packed form of one block ------------------------------------------------


def pack(fused: np.ndarray, local_bits: int) -> tuple[int, bytes, bytes, bytes]:
    """Pack sorted distinct ``quotient << 32 | remainder`` values of one block.

    ``local_bits`` is the number of quotient bits inside the block.
    """
    fused = np.asarray(fused, dtype=np.uint64)
    quotient = (fused >> np.uint64(REMAINDER_BITS)).astype(np.int64)
    occupied = np.zeros(1 << local_bits, dtype=bool)
    occupied[quotient] = True
    ends = np.ones(len(fused), dtype=bool)
    if len(fused):
        ends[:-1] = quotient[1:] != quotient[:-1]
    remainders = (fused & np.uint64(0xFFFFFFFF)).astype("<u4")
    return len(fused), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders.tobytes()


def unpack(n: int, occupied: bytes, run_ends: bytes, remainders: bytes) -> np.ndarray:
    """The sorted ``quotient << 32 | remainder`` values that ``pack`` got."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    quotients = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, dtype=np.uint8)))
    ends = np.unpackbits(np.frombuffer(run_ends, dtype=np.uint8))[:n].astype(np.int64)
    run = np.cumsum(ends) - ends  # the number of runs closed before each remainder
    return (quotients[run].astype(np.uint64) << np.uint64(REMAINDER_BITS)) | np.frombuffer(remainders, dtype="<u4").astype(np.uint64)


def merge_sorted(parts: list[np.ndarray]) -> np.ndarray:
    """Merge sorted runs without repeats."""
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    both = np.concatenate(parts)
    both.sort(kind="stable")  # timsort: linear on runs that are sorted already
    return both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both


def contains(stored: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` lie in the sorted array ``stored``."""
    if not len(stored):
        return np.zeros(len(asked), dtype=bool)
    at = np.searchsorted(stored, asked)
    return stored[np.minimum(at, len(stored) - 1)] == asked


# --- geometry --------------------------------------------------------------------


class Geometry:
    """How two hashes of a key are cut: ``block_bits`` + ``local_bits`` of the first are the quotient, 32 of the second the remainder.

    ``keys`` is the expected number of keys; it fixes the number of blocks, so that a
    block holds about ``KEYS_PER_BLOCK`` keys up to 2**62 keys. Filters of one geometry
    can be merged.
    """

    def __init__(self, keys: int, keys_per_block: int = KEYS_PER_BLOCK, local_bits: int = 16):
        self.block_bits = min(63 - local_bits, max(0, math.ceil(math.log2(max(1, keys) / keys_per_block))))
        self.local_bits = local_bits
        self.bits = self.block_bits + local_bits + REMAINDER_BITS

    def block(self, fingerprint: Column) -> Column:
        """Keys are SHA-1 digests in production; hashing again makes any key uniform."""
        return F.shiftrightunsigned(F.xxhash64(fingerprint), 64 - self.block_bits) if self.block_bits else F.lit(0).cast("long")

    def fused(self, fingerprint: Column) -> Column:
        """Quotient within the block and remainder, as one number of local_bits + 32 bits."""
        quotient = F.shiftrightunsigned(F.xxhash64(fingerprint), 64 - self.block_bits - self.local_bits).bitwiseAND(F.lit((1 << self.local_bits) - 1).cast("long"))
        remainder = F.xxhash64(fingerprint, F.lit(1)).bitwiseAND(F.lit((1 << REMAINDER_BITS) - 1).cast("long"))
        return F.shiftleft(quotient, REMAINDER_BITS).bitwiseOR(remainder)

    def wrong_rate(self, stored: int) -> float:
        """Derived probability that a new key is called seen with ``stored`` distinct keys in the filter."""
        return -math.expm1(stored * math.log1p(-(2.0**-self.bits)))


# --- filters as tables -----------------------------------------------------------


def build_filter(keys: DataFrame, geometry: Geometry, *by: str) -> DataFrame:
    """One packed filter for each value of the columns ``by`` (for instance each checkpoint).

    ``keys`` has a binary column ``fingerprint``; null keys are left out. Keys are
    made distinct before the shuffle, so a key that fills a third of all rows costs
    one row for each task.
    """
    key = F.col("fingerprint")
    rows = keys.where(key.isNotNull()).select(*by, geometry.block(key).alias("block"), geometry.fused(key).alias("_f")).distinct()
    local_bits = geometry.local_bits

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packed = pack(np.sort(pdf["_f"].to_numpy().astype(np.uint64)), local_bits)
        return pd.DataFrame([[*key, *packed]], columns=[*by, "block", "n", "occupied", "run_ends", "remainders"])

    types = dict(keys.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in by) + FILTER_SCHEMA
    return rows.groupBy(*by, "block").applyInPandas(one, schema)


def merge_filters(filters: DataFrame, geometry: Geometry) -> DataFrame:
    """Merge all filters block by block into one filter. An empty table stays empty."""
    local_bits = geometry.local_bits

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        merged = merge_sorted([unpack(*r) for r in zip(pdf["n"], pdf["occupied"], pdf["run_ends"], pdf["remainders"])])
        return pd.DataFrame([[*key, *pack(merged, local_bits)]], columns=["block", "n", "occupied", "run_ends", "remainders"])

    return filters.select("block", "n", "occupied", "run_ends", "remainders").groupBy("block").applyInPandas(one, FILTER_SCHEMA)


class FilterStore:
    """Packed filters that stay between runs, in a parquet table: the keys of a checkpoint are hashed once."""

    def __init__(self, spark: SparkSession, path: str, geometry: Geometry):
        self.spark, self.path, self.geometry = spark, path, geometry

    def add(self, keys: DataFrame) -> None:
        """``checkpoint_no, fingerprint`` of new checkpoints."""
        build_filter(keys, self.geometry, "checkpoint_no").write.mode("append").parquet(self.path)

    def merged(self) -> DataFrame:
        """One filter of all checkpoints added so far."""
        return merge_filters(self.spark.read.schema("checkpoint_no int, " + FILTER_SCHEMA).parquet(self.path), self.geometry)


def probe(filters: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (with ``block`` and ``_f``) with ``in_filter``: whether the filter has the quotient and remainder.

    The state of a task is one block's packed runs. Blocks without a filter have nothing.
    """
    schema = asked.withColumn("in_filter", F.lit(True)).schema
    names = asked.columns

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        stored = merge_sorted([unpack(*r) for r in zip(left["n"], left["occupied"], left["run_ends"], left["remainders"])])
        out = right[names].copy()
        out["in_filter"] = contains(stored, right["_f"].to_numpy().astype(np.uint64))
        return out

    return filters.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(one, schema)


# --- the question over requests --------------------------------------------------


def request_keys(requests: DataFrame) -> DataFrame:
    """``request_id, enqueue_no, fingerprint`` (binary), each request once.

    A second delivery of a ``request_id`` falls away (the smallest ``enqueue_no``
    stays). Null fingerprints, and those that are no 40 hex digits, are worked out.
    Rows with a null ``request_id`` or ``enqueue_no`` have no place in the order and
    are left out.
    """
    given = F.unhex(F.when(F.trim("fingerprint").rlike("^[0-9A-Fa-f]{40}$"), F.trim("fingerprint")))
    worked = F.unhex(request_fingerprint("url", "sid", "session_kwargs"))
    return (
        requests.where(F.col("request_id").isNotNull() & F.col("enqueue_no").isNotNull())
        .select("request_id", "enqueue_no", F.when(given.isNotNull(), given).otherwise(worked).alias("fingerprint"))
        .groupBy("request_id")
        .agg(F.min(F.struct("enqueue_no", "fingerprint")).alias("_m"))
        .select("request_id", "_m.enqueue_no", "_m.fingerprint")
    )


def entries(keys: DataFrame, geometry: Geometry) -> DataFrame:
    """What the stream puts into the filter: ``block, _f`` with the first use, the number of uses and the keys behind it.

    The stream's own keys are told apart by quotient and remainder alone, as the filter does
    it. Each task merges its uses before the shuffle, so a hot key is a row for each task.
    ``low`` and ``high`` are the least and greatest key: they differ where keys collide.
    """
    key = F.col("fingerprint")
    hashed = keys.select(geometry.block(key).alias("block"), geometry.fused(key).alias("_f"), "fingerprint", "enqueue_no", "request_id")
    return (
        hashed.groupBy("block", "_f")
        .agg(F.min(F.struct("enqueue_no", "request_id")).alias("_m"), F.count("*").alias("uses"), F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"))
        .select("block", "_f", "_m.enqueue_no", "_m.request_id", "uses", "low", "high")
    )


#: Up to so many keys of 20 bytes are broadcast to look them up among the earlier keys.
BROADCAST_KEYS = 1_000_000


def confirmed(maybe: DataFrame, seen: DataFrame) -> DataFrame:
    """``fingerprint`` of those of the ``maybe`` keys that truly are among the earlier keys.

    Few keys are broadcast, so that the earlier keys are only scanned; many meet them by shuffle.
    """
    few = maybe.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    stored = seen.where(F.col("fingerprint").isNotNull()).select("fingerprint")
    return stored.join(F.broadcast(maybe) if few else maybe, "fingerprint", "left_semi").distinct()


def new_requests(requests: DataFrame, seen: DataFrame, geometry: Geometry | None = None) -> DataFrame:
    """``request_id, called_seen`` of the requests whose key never occurred before.

    The filter decides: a first use of an entry that it doesn't have is new, and nothing else
    is looked at. Its other answers, *maybe seen*, are checked exactly where they can be
    wrong: first uses of an entry that it has, and entries behind which there are several keys.
    ``called_seen``: the filter was wrong.
    """
    geometry = geometry or Geometry(key_estimate(requests, seen))
    stored = materialise(build_filter(seen, geometry, "checkpoint_no"), "filters")
    keys = materialise(request_keys(requests), "request-keys", "snappy")
    asked = materialise(probe(merge_filters(stored, geometry), entries(keys, geometry)), "answers", "snappy")
    alone = F.col("low") == F.col("high")
    certain = asked.where(alone & ~F.col("in_filter")).select("request_id", F.lit(False).alias("called_seen"))
    maybe = asked.where(alone & F.col("in_filter"))
    known = confirmed(maybe.select(F.col("low").alias("fingerprint")), seen).withColumnRenamed("fingerprint", "low")
    wrong = maybe.join(known, "low", "left_anti").select("request_id", F.lit(True).alias("called_seen"))
    found = certain.unionByName(wrong)
    collided = asked.where(~alone)
    if collided.isEmpty():
        return found
    # keys that share an entry: each by itself, all but the entry's first use were called seen
    key = F.col("fingerprint")
    several = collided.select("block", "_f", F.col("request_id").alias("_first"), "in_filter")
    uses = keys.withColumns({"block": geometry.block(key), "_f": geometry.fused(key)}).join(several, ["block", "_f"])
    firsts = uses.groupBy("fingerprint").agg(F.min(F.struct("enqueue_no", "request_id")).alias("_m"), F.first("_first").alias("_first"), F.first("in_filter").alias("in_filter"))
    firsts = firsts.join(confirmed(firsts.select("fingerprint"), seen), "fingerprint", "left_anti")
    return found.unionByName(firsts.select("_m.request_id", (F.col("in_filter") | (F.col("_m.request_id") != F.col("_first"))).alias("called_seen")))


def key_estimate(requests: DataFrame, seen: DataFrame) -> int:
    """Upper bound of the keys to hold: the rows of both tables (from the files' footers)."""
    return seen.count() + requests.count()


def seen_requests(requests: DataFrame, seen: DataFrame, geometry: Geometry | None = None) -> DataFrame:
    """``request_id`` of each request whose key occurred before, each once.

    All requests but the new ones. That difference is taken on ``request_id``, so a key
    with a third of all rows never meets in one task. Empty tables give no rows; an
    empty ``seen`` leaves the repeats within ``requests``.
    """
    new = new_requests(requests, seen, geometry).select("request_id")
    every = requests.where(F.col("request_id").isNotNull() & F.col("enqueue_no").isNotNull()).select("request_id").distinct()
    return every.join(new, "request_id", "left_anti")


def error_report(requests: DataFrame, seen: DataFrame, geometry: Geometry | None = None) -> DataFrame:
    """One row: requests asked, new ones, wrong answers, and the measured and derived rate of wrong answers among new requests.

    A wrong answer is a new request that the filter called seen; it never calls a seen one new.
    """
    geometry = geometry or Geometry(key_estimate(requests, seen))
    new = new_requests(requests, seen, geometry).agg(F.count("*").alias("new_requests"), F.count_if("called_seen").alias("wrong_answers"))
    asked = requests.where(F.col("request_id").isNotNull() & F.col("enqueue_no").isNotNull()).agg(F.count_distinct("request_id").alias("asked_requests"))
    stored = seen.where(F.col("fingerprint").isNotNull()).agg(F.count_distinct("fingerprint").alias("stored_keys"))
    bits = geometry.bits
    held = F.col("stored_keys") + F.col("new_requests") / 2  # on average a new key meets half of the stream's keys
    return new.join(asked).join(stored).select(  # one row each
        "asked_requests",
        "stored_keys",
        "new_requests",
        "wrong_answers",
        (F.col("wrong_answers") / F.nullif("new_requests", F.lit(0))).alias("measured_rate"),
        (-F.expm1(held * F.lit(math.log1p(-(2.0**-bits))))).alias("derived_rate"),
        F.lit(bits).alias("hash_bits"),
    )
