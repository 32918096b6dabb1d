"""Encoding of a corpus by a public byte-level BPE vocabulary.

Texts are cut into *keys* at the spaces between two characters that are no white space: such
a space always begins a word of the vocabulary's pattern. So the pattern need only run
over the distinct keys, and a key's ids are the same wherever it stands. Arrow's kernels cut
a batch of texts and make its keys distinct.

The words of the distinct keys that are tokens are looked up; every other distinct word is
folded once by Spark's higher-order functions. The fold keeps one number for each piece of
the word: the rank of its pair with the next piece, its place, and its id. A step merges the
pair of the smallest number, which is the leftmost pair of lowest rank. Ranks come from a
constant of the plan: a perfect hash table from (left id, right id) to the id of both, so
a look-up is two reads by index.

The ids are put together again in Arrow batches: a batch's keys are made distinct, looked up
in the table of keys, and gathered. The table of keys is sent to the workers while it is within
``HOT_KEYS`` and ``HOT_BYTES``. Beyond, only its most frequent keys are; the others are joined
by shuffle, once for each group of documents and key.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.session import materialise, shuffle_partitions

#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the JVM, with white space spelled out and without needless backtracking.
SPACE = r"\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
JVM_PATTERN = rf"'(?:[stmd]|re|ve|ll)|\x20?+\p{{L}}++|\x20?+\p{{N}}++|\x20?+[^{SPACE}\p{{L}}\p{{N}}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WHITE = frozenset("\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000").union(map(chr, range(0x2000, 0x200B)))
#: Stands before a key that doesn't begin with a space: a noncharacter.
MARK = "\ufdd0"
#: The fold's steps grow with a word's length, and each step's work too; longer words take the library's own merge.
FOLD_BYTES = 4096
#: Bounds of the table of keys that each worker gets.
HOT_KEYS, HOT_BYTES = 1 << 20, 64 << 20
#: Bytes of input in one group of documents, where keys are joined by shuffle.
GROUP_BYTES = 8 << 20


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies; ``WEFTLINE_TOKENIZERS`` overrides the installed package's folder."""
    import os

    if "WEFTLINE_TOKENIZERS" in os.environ:
        return os.path.join(os.environ["WEFTLINE_TOKENIZERS"], name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


# --- ranks as a constant of the plan ----------------------------------------------

ID_BITS, PLACE_BITS = 16, 24
NO_ID = (1 << ID_BITS) - 1
EMPTY = 1 << 56


@functools.lru_cache(4)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """``moves, slots``: the pair (a, b) makes the token ``slots[h2 + moves[h1]] ^ (a << 32 | b << 16)`` if that is below 65,535.

    Every way to cut a token into two tokens is a pair. ``h1`` and ``h2`` are hashes of the
    pair; all pairs of one ``h1`` are moved together, so far that no two pairs share a slot.
    """
    ranks = load_ranks(path)
    if max(ranks.values(), default=0) >= NO_ID:
        raise ValueError("the vocabulary needs ids below 65,535")
    digest, packed = xxhash.xxh64_intdigest, {i: i.to_bytes(8, "little") for i in ranks.values()}
    first = {i: digest(p, 42) for i, p in packed.items()}  # the seed of Spark's xxhash64
    together: dict[int, list[tuple[int, int]]] = {}
    for token, made in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                h1, h2 = digest(packed[left], first[right]) >> 48, digest(packed[right], first[left]) >> 46
                together.setdefault(h1, []).append((h2, left << 2 * ID_BITS | right << ID_BITS | made))
    moves, used = np.zeros(1 << 16, dtype=np.int32), {}
    for h1, pairs in sorted(together.items(), key=lambda x: -len(x[1])):
        move = 0
        while any(h2 + move in used for h2, _ in pairs) or len({h2 for h2, _ in pairs}) < len(pairs):
            if move > 1 << 16:
                raise ValueError("the vocabulary needs more slots")
            move += 1
        moves[h1] = move
        used.update((h2 + move, value) for h2, value in pairs)
    slots = np.full((1 << 18) + int(moves.max(initial=0)) + 1, EMPTY, dtype=np.int64)
    slots[list(used)] = list(used.values())
    return moves, slots


@functools.lru_cache(4)
def byte_table(path: str) -> tuple[int, np.ndarray]:
    """A shift, and the ids of the 256 bytes by 16 bits of their hash from that shift on, which differ for all bytes."""
    ranks = load_ranks(path)
    hashes = np.array([xxhash.xxh64_intdigest(bytes([b]), 42) for b in range(256)], dtype=np.uint64)  # the seed of Spark's xxhash64
    for shift in range(48):
        at = ((hashes >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
        if len(set(at.tolist())) == 256:
            ids = np.full(1 << 16, NO_ID, dtype=np.int64)
            ids[at] = [ranks.get(bytes([b]), NO_ID) for b in range(256)]
            return shift, ids
    raise ValueError("no bits of the hash tell all bytes apart")


def byte_slot(byte: Column, path: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(byte), byte_table(path)[0]).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")


def rank_table(spark: SparkSession, path: str) -> Column:
    """The pair table as one constant, ``struct<moves: array<int>, slots: array<bigint>, bytes: array<bigint>>``.

    A scalar subquery: it is evaluated once and sent to the tasks as a constant, but,
    unlike a literal, it doesn't put megabytes of text into every printed plan.
    """
    moves, slots = pair_table(path)
    one = pa.table({"moves": pa.array([moves]), "slots": pa.array([slots]), "bytes": pa.array([byte_table(path)[1]])})
    return spark.createDataFrame(one).select(F.struct("moves", "slots", "bytes")).scalar()


def let(value: Column, kind: str, body: Callable[[Column], Column]) -> Column:
    """``body`` (of the type ``kind``) with ``value`` evaluated once.

    An aggregate over one element: unlike an element of a transformed array, its type
    is known without walking through the body each time.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, bound: body(bound))


def fold_merges(word: Column, table: Column, path: str) -> Column:
    """The token ids of one word (binary) by ranked merges; a null word gives null.

    The state has a number for each piece: the rank of its pair with the next piece above
    its id. Arrays are put together by ``flatten`` and the best pair is found by a minimum
    over numbers with their place, since ``concat`` and ``array_position`` are slow where
    they are interpreted.
    """
    moves, slots, byte_ids = table["moves"], table["slots"], table["bytes"]
    none, shift = F.lit(NO_ID).cast("long"), ID_BITS + PLACE_BITS
    nothing = F.lit(NO_ID << shift | NO_ID).cast("long")
    place_mask = F.lit((1 << PLACE_BITS) - 1).cast("long")
    id_of = lambda x: x.bitwiseAND(none)

    def joined(left: Column, right: Column) -> Column:
        """The id of both pieces together above the left one's id; NO_ID without one."""
        move = F.get(moves, F.shiftrightunsigned(F.xxhash64(right, left), 48).cast("int"))
        value = F.get(slots, F.shiftrightunsigned(F.xxhash64(left, right), 46).cast("int") + move)
        made = F.least(value.bitwiseXOR(F.shiftleft(left, 2 * ID_BITS).bitwiseOR(F.shiftleft(right, ID_BITS))), none)
        return F.shiftleft(made, shift).bitwiseOR(left)

    def started(ids: Column) -> Column:
        """A first item that joins nothing, so that each pair has one before it, and an item for each byte."""
        return F.flatten(F.array(F.array(nothing), F.transform(ids, lambda x, i: joined(x, F.get(ids, i + 1)))))

    size = F.octet_length(word)
    ids = F.transform(F.sequence(F.lit(1), size), lambda i: F.get(byte_ids, byte_slot(F.substring(word, i, F.lit(1)), path)))

    def merge(state: Column, _: Column) -> Column:
        placed = F.array_min(F.transform(state, lambda x, i: x.bitwiseOR(F.shiftleft(i.cast("long"), ID_BITS))))

        def at(best: Column) -> Column:
            own = F.shiftright(best, shift)

            def rebuilt(i: Column) -> Column:
                return F.flatten(F.array(
                    F.slice(state, F.lit(1), i - 1),
                    F.array(joined(id_of(F.get(state, i - 1)), own), joined(own, id_of(F.get(state, i + 2)))),
                    F.slice(state, i + 3, size),
                ))

            return F.when(best >= F.lit(NO_ID << shift), state).otherwise(let(F.shiftright(best, ID_BITS).bitwiseAND(place_mask).cast("int"), "array<bigint>", rebuilt))

        return let(placed, "array<bigint>", at)

    steps = F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, let(ids, "array<bigint>", started), merge, lambda end: F.transform(F.slice(end, F.lit(2), size), lambda x: id_of(x).cast("int")))


# --- keys, words and documents ----------------------------------------------------


def words_of(text: Column) -> Column:
    """The words of a text; joined they are the text again. Empty and null texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(JVM_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def keys_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The keys of a batch of texts, and how many each text has; no text has none. All but loose texts by Arrow's kernels."""
    lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK), texts, ""), " ")
    counts = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    pieces = lists.flatten().dictionary_encode()
    distinct, at = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
    first = np.zeros(len(at), dtype=bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    # a space beside other white space, or before a MARK of the text itself, begins no key
    head = np.fromiter((p == "" or p[0] in WHITE or p[0] == MARK for p in distinct), bool, len(distinct))
    tail = np.fromiter((p == "" or p[-1] in WHITE for p in distinct), bool, len(distinct))
    held = ~first & head[at]
    held[1:] |= ~first[1:] & tail[at[:-1]]
    if not held.any():
        return pieces, counts
    ends = np.flatnonzero(~held)
    sizes = np.diff(np.append(ends, len(at)))
    places, new = at[ends], {}
    for k in np.flatnonzero(sizes > 1):
        key = " ".join(distinct[i] for i in at[ends[k] : ends[k] + sizes[k]])
        places[k] = new.setdefault(key, len(distinct) + len(new))
    starts = np.cumsum(counts) - counts
    kept = np.concatenate([[0], np.cumsum(~held)])
    counts = kept[starts + counts] - kept[starts]
    return pa.DictionaryArray.from_arrays(pa.array(places, pa.int32()), pa.array([*distinct, *new], pa.string())), counts


def key_text(key: Column) -> Column:
    return F.when(F.startswith(key, F.lit(MARK)), F.substring(key, F.lit(2), F.length(key))).otherwise(F.concat(F.lit(" "), key))


def rank_rows(spark: SparkSession, path: str) -> DataFrame:
    """``token`` (binary), ``id``: the whole vocabulary."""
    ranks = load_ranks(path)
    return spark.createDataFrame(pd.DataFrame({"token": list(ranks), "id": list(ranks.values())}), "token binary, id int")


@functools.lru_cache(4)
def native(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def _encode_long(path: str):
    @F.pandas_udf("array<int>")
    def encode(words: pd.Series) -> pd.Series:
        return words.map(lambda w: native(path)._encode_single_piece(w) if w is not None else None)

    return encode


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``word, ids`` of distinct words (string) that are no tokens themselves."""
    short = F.octet_length("word") <= FOLD_BYTES
    table = rank_table(words.sparkSession, path)
    # two projections: a subquery may not be written inside a higher-order function; the optimizer joins them
    bound = words.where(short).select("word", table.alias("_table"))
    folded = bound.select("word", let(F.col("_table"), "array<int>", lambda t: fold_merges(F.col("word").cast("binary"), t, path)).alias("ids"))
    long = words.where(~short).repartition("word")  # few words: adaptive execution leaves few partitions that need Python
    return folded.unionByName(long.select("word", _encode_long(path)("word").alias("ids")))


class KeyTable:
    """Ids by key, for look-ups in batches."""

    def __init__(self, rows: pa.Table):
        rows = rows.cast(KEY_ROWS).combine_chunks()
        lists = rows["ids"].combine_chunks()
        self.at = {k: i for i, k in enumerate(rows["key"].to_pylist())}
        self.length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.ids = lists.flatten().to_numpy()
        self.rows = rows

    def rows_of(self, texts: list[pa.Array]) -> pa.Table:
        """The rows of those of the texts' keys that are here."""
        asked = {k for t in texts for k in keys_of(t)[0].dictionary.to_pylist()}
        return self.rows.take(pa.array([self.at[k] for k in asked if k in self.at], pa.int64()))

    def encoded(self, texts: pa.Array) -> pa.Array:
        """The ids of texts. A key that isn't there is an error: all were encoded."""
        keys, counts = keys_of(texts)
        at, where = self.at, keys.indices.to_numpy()
        asked = np.bincount(where, minlength=len(keys.dictionary)) > 0
        place = np.fromiter((at[k] if a else 0 for k, a in zip(keys.dictionary.to_pylist(), asked.tolist())), np.int64, len(asked))
        place = place[where] if len(place) else place
        lengths = self.length[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[place] - ends[:-1], lengths)]
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


_TABLES: dict[str, KeyTable] = {}


def _table(name: str, packed: bytes) -> KeyTable:
    """One table for each worker process, however many tasks it runs."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = KeyTable(pa.ipc.open_stream(packed).read_all())
    return _TABLES[name]


KEY_ROWS = pa.schema([("key", pa.string()), ("ids", pa.list_(pa.int32()))])
ID_SCHEMA = "doc_id long, ids array<int>"


def _keys_in(documents: DataFrame, *by: str) -> DataFrame:
    """``key, n`` of each batch of texts, for each value of the integer column ``by`` if there is one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = keys_of(batch["text"])
            if not len(keys):
                continue
            at = keys.indices.to_numpy().astype(np.int64)
            names = [np.repeat(batch[c].to_numpy(), counts).astype(np.int64) for c in by]
            code = at + (names[0] * len(keys.dictionary) if by else 0)
            found, n = np.unique(code, return_counts=True)
            columns = [pa.array(found // len(keys.dictionary), pa.int32()) for _ in by]
            yield pa.RecordBatch.from_arrays([*columns, keys.dictionary.take(pa.array(found % len(keys.dictionary))), pa.array(n, pa.int64())], names=[*by, "key", "n"])

    return documents.select(*by, "text").mapInArrow(scan, "".join(f"{c} int, " for c in by) + "key string, n long")


RESULT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _result(docs, ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([docs.cast(pa.int64()), ids], schema=RESULT)


class Encoder:
    """Encodes the column ``text`` of documents with unique ``doc_id``; rows with a null id are left out.

    The ids of the distinct keys are written into the shared folder once, so a lost
    executor costs no more than its own tasks.
    """

    def __init__(self, documents: DataFrame, path: str | None = None, hot_keys: int = HOT_KEYS, hot_bytes: int = HOT_BYTES):
        self.path = path or vocabulary_path()
        self.spark = documents.sparkSession
        self.documents = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.make_valid_utf8("text").alias("text"))
        self.hot_keys, self.hot_bytes = hot_keys, hot_bytes

    def distinct_keys(self) -> DataFrame:
        """``key, n``: the distinct keys and how often each stands in the corpus; counted in each batch first."""
        return _keys_in(self.documents).groupBy("key").agg(F.sum("n").alias("n"))

    def vocabulary(self) -> DataFrame:
        """``key, n, ids`` of all distinct keys."""
        keys = materialise(self.distinct_keys(), "keys", "snappy")
        words = keys.select("key", "n", F.posexplode_outer(words_of(key_text(F.col("key")))).alias("pos", "word"))
        ranks = rank_rows(self.spark, self.path)
        # tokens that are no text by themselves never are a word
        own = ranks.where(F.is_valid_utf8(F.col("token").cast("string"))).select(F.col("token").cast("string").alias("word"), F.array("id").alias("ids"))
        rare = words.select("word").where(F.col("word").isNotNull()).join(F.broadcast(own.select("word")), "word", "left_anti").distinct()
        folded = materialise(encode_words(rare, self.path), "word-ids", "snappy")
        known = words.join(F.broadcast(own), "word", "left")
        plain = known.where(F.col("ids").isNotNull() | F.col("word").isNull())
        other = known.where(F.col("ids").isNull() & F.col("word").isNotNull()).drop("ids").join(folded, "word")
        found = plain.select("key", "n", "pos", "ids").unionByName(other.select("key", "n", "pos", "ids"))
        lists = found.groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids")))).alias("_w"))
        return materialise(lists.select("key", "n", F.flatten(F.col("_w.ids")).alias("ids")), "key-ids", "snappy")

    def hot(self, vocabulary: DataFrame) -> tuple[DataFrame, bool]:
        """The most frequent keys within the bounds, and whether that is all of them. Keys are taken by powers of two of their frequency."""
        power = F.floor(F.log2("n")).cast("int")
        size = F.octet_length("key") + 4 * F.size("ids")
        classes = vocabulary.groupBy(power.alias("power")).agg(F.count("*").alias("keys"), F.sum(size).alias("bytes")).orderBy(F.desc("power")).collect()  # at most 63 rows
        keys = bytes_ = 0
        least = None
        for c in classes:
            keys, bytes_ = keys + c["keys"], bytes_ + c["bytes"]
            if keys > self.hot_keys or bytes_ > self.hot_bytes:
                break
            least = c["power"]
        every = not classes or least == classes[-1]["power"]
        return vocabulary.where(power >= least) if least is not None else vocabulary.where(F.lit(False)), every

    def ids(self) -> DataFrame:
        """``doc_id, ids``. Empty and null texts, and texts without words, have an empty list."""
        vocabulary = self.vocabulary()
        hot, every = self.hot(vocabulary)
        table = hot.select("key", "ids").toArrow()  # within HOT_KEYS and HOT_BYTES
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        sent, name = self.spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex

        if every:

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield _result(batch["doc_id"], _table(name, sent.value).encoded(batch["text"]))

            return self.documents.mapInArrow(scan, ID_SCHEMA)

        size = int(str(self.documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        # no more groups than documents: the size of tables that aren't files is unknown, and taken for enormous
        groups = max(shuffle_partitions(self.spark), min(-(-size // GROUP_BYTES), self.documents.count()))
        dealt = self.documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("group_no"), "doc_id", "text")
        asked = _keys_in(dealt, "group_no").select("group_no", "key").distinct()
        rare = asked.join(hot.select("key"), "key", "left_anti").join(vocabulary.select("key", "ids"), "key")

        def put(docs: pa.Table, rare: pa.Table) -> pa.Table:
            batches = docs.to_batches()
            rows = pa.concat_tables([_table(name, sent.value).rows_of([b["text"] for b in batches]), rare.select(["key", "ids"]).cast(KEY_ROWS)])
            found = KeyTable(rows)
            return pa.Table.from_batches([_result(b["doc_id"], found.encoded(b["text"])) for b in batches], schema=RESULT)

        return dealt.groupBy("group_no").cogroup(rare.groupBy("group_no")).applyInArrow(put, ID_SCHEMA)


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``: the tokens' bytes, put together. Ids outside the vocabulary give null."""
    path = path or vocabulary_path()
    spark = encoded.sparkSession
    tokens = F.broadcast(rank_rows(spark, path).select(F.col("id").alias("_id"), F.hex("token").alias("_hex")))
    pieces = encoded.select("doc_id", F.posexplode_outer("ids").alias("_pos", "_id"))
    joined = pieces.join(tokens, "_id", "left").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_hex"))).alias("_t"), F.count_if(F.col("_id").isNotNull() & F.col("_hex").isNull()).alias("_bad")
    )
    text = F.unhex(F.array_join(F.col("_t._hex"), "")).cast("string")
    return joined.select("doc_id", F.when(F.col("_bad") == 0, text).alias("text"))


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` by the library's own encoder, a batch of texts at a time; 0 for null and empty texts."""
    path = path or vocabulary_path()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = native(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", count("text").alias("n_tokens"))
