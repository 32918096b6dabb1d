"""Filling containers of fixed capacity: first-fit decreasing in randomised groups.

Documents are dealt into groups by a hash of their id, about ``group_size`` to a
group, and each group is packed by itself: items in falling order of size, each into
the first bin with room, found in a tournament tree over the bins' free room in
``log(bins)`` steps. A group is bounded whatever the data, so no task grows with the
corpus; with thousands of items a group loses at most its last bins.

An item longer than the capacity is cut into pieces of the capacity and a rest; no
other item is split. Items of size 0 take no room and lie in the first bin of their
group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

GROUP_SIZE = 20_000


class Tournament:
    """The first bin with at least so much room."""

    def __init__(self, bins: int, capacity: int):
        self.base = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.room = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.base:
            at *= 2
            if room[at] < size:
                at += 1
        left = room[at] = room[at] - size
        found = at - self.base
        while at > 1:
            other = room[at ^ 1]
            at >>= 1
            left = left if left > other else other
            if room[at] == left:
                break
            room[at] = left
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, items in falling order of size (ties in the given order). Sizes are at most the capacity."""
    order = np.argsort(-sizes, kind="stable")
    # first fit leaves at most one bin not over half full
    tree = Tournament(min(len(sizes), 2 * int(sizes.sum()) // max(1, capacity) + 2), capacity)
    bins = np.empty(len(sizes), dtype=np.int64)
    place = tree.place
    bins[order] = [place(s) for s in sizes[order].tolist()]
    return bins


def pack(items: DataFrame, capacities: list[tuple[int, int]], group_size: int = GROUP_SIZE, items_count: int | None = None) -> DataFrame:
    """Pack ``doc_id, n_tokens`` into windows of each ``(window_id, capacity)``.

    Returns ``window_id, group_no, bin_no, doc_id, piece_no, piece_start, n_tokens``: in
    which bin (of its group) lies which document or piece of it, ``piece_no`` from 0.
    Null ids are left out, null sizes count as 0; capacities that are null or not positive are left out. An
    empty table gives no rows.
    """
    capacities = [(w, c) for w, c in capacities if c is not None and c > 0]
    count = items.count() if items_count is None else items_count
    groups = max(1, -(-count // group_size))
    schema = "window_id int, group_no int, bin_no long, doc_id long, piece_no int, piece_start long, n_tokens long"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        sizes, docs, out = pdf["n_tokens"].to_numpy(np.int64), pdf["doc_id"].to_numpy(), []
        for window, capacity in capacities:
            pieces = np.maximum(1, -(-sizes // capacity))
            doc = np.repeat(np.arange(len(docs)), pieces)
            no = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(sizes[doc] - no * capacity, capacity)
            out.append(
                pd.DataFrame(
                    {"window_id": window, "group_no": key[0], "bin_no": first_fit_decreasing(size, capacity), "doc_id": docs[doc], "piece_no": no, "piece_start": no * capacity, "n_tokens": size}
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    dealt = items.where(F.col("doc_id").isNotNull()).select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("group_no"), "doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    return dealt.groupBy("group_no").applyInPandas(one, schema)


def fill_report(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """For each window size: bins, tokens, pieces and the share of room left unused."""
    room = F.create_map(*[F.lit(x) for pair in capacities for x in pair])
    bins = packed.groupBy("window_id", "group_no", "bin_no").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"))
    return (
        bins.groupBy("window_id")
        .agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"), F.sum("p").alias("pieces"))
        .withColumn("capacity", F.element_at(room, F.col("window_id")))
        .withColumn("unused", 1 - F.col("tokens") / (F.col("bins") * F.col("capacity")))
    )


def validity(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """For each window size: documents, bins over the capacity, documents split although they fit, and documents with a piece missing.

    A document longer than the capacity has pieces of the capacity and a rest, without gaps; all others are whole.
    """
    room = F.create_map(*[F.lit(x) for pair in capacities for x in pair])
    capacity = F.element_at(room, F.col("window_id"))
    bins = packed.groupBy("window_id", "group_no", "bin_no").agg(F.sum("n_tokens").alias("t"))
    over = bins.groupBy("window_id").agg(F.count_if(F.col("t") > capacity).alias("overfull_bins"))
    documents = packed.groupBy("window_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("t"), F.max("piece_no").alias("last"), F.count_if(F.col("piece_start") != F.col("piece_no") * capacity).alias("gaps"))
    found = documents.groupBy("window_id").agg(
        F.count("*").alias("documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("t") <= capacity)).alias("wrongly_split"),
        F.count_if((F.col("last") + 1 != F.col("pieces")) | (F.col("gaps") > 0) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("t") / capacity)))).alias("incomplete"),
    )
    return found.join(over, "window_id").select("window_id", "documents", "overfull_bins", "wrongly_split", "incomplete")
