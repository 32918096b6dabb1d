"""Structural similarity of elements: fingerprints, scores, relocation, similar elements, and the store.

A fingerprint is a struct ``tag, attributes, text, path, parent_name, parent_attribs,
parent_text, siblings, children``. Scores run on Arrow batches, since Jaro-Winkler has no
built-in expression; candidates come from equi-joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.functions.http import store_scope

FINGERPRINT = (
    "struct<tag:string,attributes:map<string,string>,text:string,path:array<string>,parent_name:string,parent_attribs:map<string,string>,parent_text:string,"
    "siblings:array<string>,children:array<string>>"
)
SPECIFIC = ("class", "id", "href", "src")
SIMILAR_THRESHOLD = 0.2


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, t in zip(b, taken) if t]
    m, moved = len(first), sum(x != y for x, y in zip(first, second)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four characters where it is over 0.7."""
    score = jaro(a, b)
    if score <= 0.7:
        return score
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return score + 0.1 * prefix * (1 - score)


def sequence_ratio(x: Column, y: Column) -> Column:
    """1.0 for equal texts, else Jaro-Winkler; null if either is null."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else jaro_winkler(a, b) for a, b in zip(left, right)], dtype="float64")

    return ratio(x, y)


def list_ratio(x: Column, y: Column) -> Column:
    return sequence_ratio(F.array_join(x, " "), F.array_join(y, " "))


def map_ratio(x: Column, y: Column) -> Column:
    """Half the ratio of the names and half that of the values, both in the order of the sorted pairs."""
    def side(m: Column, part: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: e[part]), " ")

    return 0.5 * sequence_ratio(side(x, "key"), side(y, "key")) + 0.5 * sequence_ratio(side(x, "value"), side(y, "value"))


def _map_score(a: dict, b: dict) -> float:
    left, right = sorted(a.items()), sorted(b.items())
    join = lambda pairs, i: " ".join(p[i] for p in pairs)
    return 0.5 * jaro_winkler(join(left, 0), join(right, 0)) + 0.5 * jaro_winkler(join(left, 1), join(right, 1))


def score(original: dict, candidate: dict) -> float:
    """Similarity of two fingerprints from 0 to 100, the mean of the factors that the original has, at two digits."""
    a, b = original["attributes"] or {}, candidate["attributes"] or {}
    parts = [float(original["tag"] == candidate["tag"])]
    if original["text"] is not None:
        parts.append(jaro_winkler(original["text"], candidate["text"] or ""))
    parts.append(_map_score(a, b))
    parts += [jaro_winkler(a[k], b.get(k, "")) for k in SPECIFIC if k in a]
    join = lambda x: " ".join(x if x is not None else ())
    parts.append(jaro_winkler(join(original["path"]), join(candidate["path"])))
    if original["parent_name"] is not None and candidate["parent_name"] is not None:
        parts.append(jaro_winkler(original["parent_name"], candidate["parent_name"]))
        parts.append(_map_score(original["parent_attribs"] or {}, candidate["parent_attribs"] or {}))
        if original["parent_text"] is not None:
            parts.append(jaro_winkler(original["parent_text"], candidate["parent_text"] or ""))
    if original["siblings"] is not None and len(original["siblings"]):
        parts.append(jaro_winkler(join(original["siblings"]), join(candidate["siblings"])))
    return int(sum(parts) / len(parts) * 10000 + 0.5) / 100


def similarity_score(original: Column, candidate: Column) -> Column:
    @F.pandas_udf("double")
    def scores(left: pd.DataFrame, right: pd.DataFrame) -> pd.Series:
        return pd.Series([score(a, b) for a, b in zip(left.to_dict("records"), right.to_dict("records"))], dtype="float64")

    return scores(original, candidate)


def fingerprints(table: DataFrame) -> DataFrame:
    """``page_id, url, node_id, fp`` of every node of a node table.

    Own attributes are trimmed and lose empty values, the parent's are kept as they are;
    blank texts are null. Siblings and children are tags in document order.
    """
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    own = F.map_filter(F.transform_values("attrs", lambda k, v: trim(v)), lambda k, v: v != "")
    text = F.nullif(trim(F.col("own_text")), F.lit(""))
    base = table.select("page_id", "url", "node_id", "parent_id", "tag", own.alias("attributes"), text.alias("text"), "path", "elem_idx", "attrs")
    kids = (
        table.where(F.col("parent_id").isNotNull())
        .groupBy("page_id", F.col("parent_id").alias("node_id"))
        .agg(F.array_sort(F.collect_list(F.struct("node_id", "tag"))).alias("_k"))
        .select("page_id", "node_id", F.col("_k.tag").alias("children"))
    )
    base = base.join(kids, ["page_id", "node_id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    up = base.select("page_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("parent_name"), F.col("attrs").alias("parent_attribs"), F.col("text").alias("parent_text"), F.col("children").alias("_all"))
    both = base.join(up, ["page_id", "parent_id"], "left")
    siblings = F.coalesce(F.filter("_all", lambda t, i: i + 1 != F.col("elem_idx")), F.array().cast("array<string>"))
    fp = F.struct("tag", "attributes", "text", "path", "parent_name", "parent_attribs", "parent_text", siblings.alias("siblings"), "children")
    return both.select("page_id", "url", "node_id", fp.alias("fp"))


#: Up to so many stored fingerprints, of some kilobytes each, are broadcast.
BROADCAST_ROWS = 10_000


def relocate(found: DataFrame, originals: DataFrame, least: float = 0.0) -> DataFrame:
    """``page_id, identifier, node_id, score``: the nodes of each page most like a stored fingerprint.

    ``originals``: ``base_url, identifier, fp``. A page meets the fingerprints of its own
    site only. All ties at the highest score stay, if it reaches ``least`` and is over 0.
    """
    scoped = found.withColumn("base_url", store_scope("url"))
    known = originals.select("base_url", "identifier", F.col("fp").alias("_o"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)  # a site with a tenth of all nodes is not brought together
    scored = scoped.join(known, "base_url").select(
        "page_id", "identifier", "node_id", similarity_score(F.col("_o"), F.col("fp")).alias("score")
    )
    best = F.max("score").over(Window.partitionBy("page_id", "identifier"))
    return scored.withColumn("_b", best).where((F.col("score") == F.col("_b")) & (F.col("_b") >= least) & (F.col("_b") > 0)).drop("_b")


def save(store: DataFrame, new: DataFrame, at: str = "saved_at") -> DataFrame:
    """Upsert of ``base_url, identifier, fp, saved_at``: the last write for each key stays; of writes at the same time that of the greatest text."""
    both = store.unionByName(new)
    return both.groupBy("base_url", "identifier").agg(F.max_by("fp", F.struct(F.col(at), F.to_json(F.struct("fp")))).alias("fp"), F.max(at).alias(at))


def retrieve(store: DataFrame, base_url: str, identifier: str) -> DataFrame:
    return store.where((F.col("base_url") == base_url) & (F.col("identifier") == identifier))


class FingerprintStore:
    """The fingerprint store as a table that stays: each write appends, a read takes the last write for each key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, new: DataFrame) -> None:
        """Adds ``base_url, identifier, fp``."""
        new.select("base_url", "identifier", "fp", F.current_timestamp().alias("saved_at")).write.mode("append").parquet(self.path)

    def load(self) -> DataFrame | None:
        """``base_url, identifier, fp, saved_at``; null before the first write."""
        from weftline.operators.crawl import path_exists

        if not path_exists(self.spark, self.path):
            return None
        table = self.spark.read.parquet(self.path)
        return save(table.where(F.lit(False)), table)


def css_adaptive(table: DataFrame, selector: str, store: DataFrame | None, identifier: str | None = None, least: float = 0.0, adaptive: bool = True) -> DataFrame:
    """``page_id, node_id, score``: matches of the selector, and on pages without one the relocated nodes.

    The identifier is the selector itself by default. Without ``adaptive``, or without a
    store, such pages have none.
    """
    from weftline.operators.nodes import css

    hits = css(table, selector).select("page_id", "node_id", F.lit(None).cast("double").alias("score"))
    if not adaptive or store is None:
        return hits
    missing = table.join(hits.select("page_id").distinct(), "page_id", "left_anti")
    moved = relocate(fingerprints(missing), store.where(F.col("identifier") == (identifier or selector)), least)
    return hits.unionByName(moved.select("page_id", "node_id", "score"))


def to_save(table: DataFrame, found: DataFrame, identifier: str) -> DataFrame:
    """``base_url, identifier, fp`` of the first found node of each site's last page that has one.

    Saving page by page, in the order of ``page_id``, would leave the same in the store.
    """
    firsts = found.groupBy("page_id").agg(F.min("node_id").alias("node_id"))
    prints = fingerprints(table).join(firsts, ["page_id", "node_id"]).withColumn("base_url", store_scope("url"))
    return prints.groupBy("base_url").agg(F.max_by("fp", "page_id").alias("fp")).select("base_url", F.lit(identifier).alias("identifier"), "fp")


def css_adaptive_saved(table: DataFrame, selector: str, store: FingerprintStore, identifier: str | None = None, least: float = 0.0, adaptive: bool = True) -> DataFrame:
    """``css_adaptive`` that also saves the first node of each page, whether it was matched or relocated."""
    from weftline.session import materialise

    found = materialise(css_adaptive(table, selector, store.load(), identifier, least, adaptive), "adaptive")
    store.save(to_save(table, found, identifier or selector))
    return found


def attribute_similarity(left: dict, right: dict, ignored: tuple[str, ...] = ("href", "src"), texts: tuple[str, str] | None = None) -> float:
    """Mean over the union of names: 1 for equal values, Jaro-Winkler for others, 0 for a missing one."""
    a = {k: v for k, v in left.items() if k not in ignored}
    b = {k: v for k, v in right.items() if k not in ignored}
    if not a and not b:
        return 1.0 if texts is None else float(texts[0] == texts[1])
    parts = [jaro_winkler(a[k], b[k]) if k in a and k in b else 0.0 for k in a.keys() | b.keys()]
    if texts is not None:
        parts.append(jaro_winkler(*texts))
    return sum(parts) / len(parts)


def find_similar(table: DataFrame, chosen: DataFrame, threshold: float = SIMILAR_THRESHOLD, match_text: bool = False, ignored: tuple[str, ...] = ("href", "src")) -> DataFrame:
    """Nodes of the chosen node's page with its tag, depth and parent's tag, and similar attributes. Adds ``of_id``."""
    parent = F.get("path", F.size("path") - 2)

    @F.pandas_udf("double")
    def similar(left: pd.Series, right: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
        rows = zip(left, right, one, two)
        return pd.Series([attribute_similarity(dict(a), dict(b), ignored, (s, t) if match_text else None) for a, b, s, t in rows], dtype="float64")

    keys = chosen.select(
        "page_id", "tag", "depth", F.coalesce(parent, F.lit("")).alias("parent_tag"), F.col("node_id").alias("of_id"), F.col("attrs").alias("_a"), F.trim("own_text").alias("_t")
    )
    found = table.withColumn("parent_tag", F.coalesce(parent, F.lit(""))).join(keys, ["page_id", "tag", "depth", "parent_tag"]).where(F.col("node_id") != F.col("of_id"))
    return found.where(similar("_a", "attrs", "_t", F.trim("own_text")) >= threshold).drop("_a", "_t")
