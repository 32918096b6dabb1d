"""Lines repeated across the documents of one site.

Plain-text responses are grouped by site. Responses of a site with the same bytes
are collapsed into one *cluster* first, and lines are counted once for each cluster:
how many clusters hold it, how many responses these clusters stand for, and on how
many days they were fetched. A republished article is one cluster of many responses,
so ``min_clusters`` and ``min_days`` tell it from boilerplate; the count of responses
alone does not.

Hot sites, lines and clusters: a line is distinct within its document before it is
exploded, so each count is a plain sum with partial aggregation, and no task ever
holds all rows of a site. Lines that make up more than ``1 / HOT_SHARE`` of all lines
(at most ``HOT_SHARE`` of them, whatever the data) are joined by broadcast, the rest
by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.http import host, media_type
from weftline.session import materialise

HOT_SHARE = 1000
#: Copies of one document that make up more than ``1 / HOT_SHARE`` of all are dealt over so many tasks.
SALTS = 64
#: Up to so many request ids, of 8 bytes each, are broadcast.
BROADCAST_IDS = 1_000_000


def site_of(url: Column) -> Column:
    """Host in lower case, without user, port and leading ``www.``; null where there is none."""
    return F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def utf8(body: str) -> Column:
    """A binary column read as UTF-8, with U+FFFD for what is no UTF-8."""
    return F.make_valid_utf8(F.col(body).cast("string"))


def line_key(line: Column) -> Column:
    """The form under which two lines are the same; empty for a blank line."""
    spaced = F.trim(F.regexp_replace(line, "[ \\t\\r\\f\\u00a0]+", " "))
    return F.regexp_replace(F.lower(spaced), "[0-9]+", "0")


def text_documents(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """``response_id, site, day, body`` of the text/plain responses.

    The site is that of the request's url, or of the response's own url where
    ``request_id`` is null or names no request. Null sites form a site of their own;
    null bodies have no lines;
    rows with a null id are left out.
    """
    plain = responses.where(F.col("response_id").isNotNull() & (media_type(F.col("headers")) == "text/plain")).select(
        "response_id", "request_id", site_of(F.col("url")).alias("_own"), F.to_date("fetched_at").alias("day"), "body"
    )
    # requests are many and wide; only the sites of those wanted are kept, once for each id
    wanted = plain.where(F.col("request_id").isNotNull()).select("request_id").distinct()
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    asked = (
        requests.where(F.col("request_id").isNotNull())
        .join(wanted, "request_id", "left_semi")
        .select("request_id", site_of(F.col("url")).alias("_site"))
        .groupBy("request_id")
        .agg(F.min("_site").alias("_site"))
    )
    named = plain.where(F.col("request_id").isNotNull()).join(asked, "request_id", "left")
    loose = plain.where(F.col("request_id").isNull()).withColumn("_site", F.lit(None).cast("string"))
    return named.unionByName(loose).select("response_id", F.coalesce("_site", "_own", F.lit("")).alias("site"), "day", "body")


def clusters(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``site, cluster, response_id, day`` and texts ``site, cluster, body`` (one row each cluster)."""
    keyed = documents.select("site", F.xxhash64("body", F.octet_length("body")).alias("cluster"), "response_id", "day", "body")
    members = keyed.select("site", "cluster", "response_id", "day")
    texts = keyed.where(F.col("body").isNotNull()).groupBy("site", "cluster").agg(F.any_value("body").alias("body"))
    return members, texts


def numbered_lines(texts: DataFrame) -> DataFrame:
    """``site, cluster, line_no, line_hash`` of the lines that are not blank; lines count from 1, split at LF."""
    lines = F.split(utf8("body"), "\n")
    return (
        texts.select("site", "cluster", F.posexplode(lines).alias("_i", "line"))
        .select("site", "cluster", (F.col("_i") + 1).alias("line_no"), line_key(F.col("line")).alias("_k"))
        .where(F.col("_k") != "")
        .select("site", "cluster", "line_no", F.xxhash64("_k", F.reverse("_k")).alias("line_hash"))
    )


class RepeatedLines:
    """Lines repeated within a site; see the module's text.

    ``min_responses`` is the number of different responses of a site, the line's own
    included, from which on a line is repeated. ``min_clusters`` and ``min_days`` ask
    in addition for so many different documents and days.

    The clusters' lines are written once into the shared folder and read for the
    counts and for the answer.
    """

    def __init__(self, responses: DataFrame, requests: DataFrame, min_responses: int = 4, min_clusters: int = 1, min_days: int = 1):
        self.documents = text_documents(responses, requests)
        members, texts = clusters(self.documents)
        self.members = materialise(members, "line-members")
        self.lines = materialise(numbered_lines(texts), "lines")
        self.least = (min_responses, min_clusters, min_days)

    def counts(self) -> DataFrame:
        """``site, line_hash, responses, clusters, days, occurrences`` of every line.

        Days are counted by the first day of each cluster (unknown days as one), so that a republished
        article adds one day.
        """
        size = self.members.groupBy("site", "cluster").agg(F.count_distinct("response_id").alias("_n"), F.min("day").alias("_day"))
        once = self.lines.groupBy("site", "cluster", "line_hash").agg(F.count("*").alias("_times"))
        return (
            once.join(size, ["site", "cluster"])
            .groupBy("site", "line_hash", "_day")
            .agg(F.sum("_n").alias("_n"), F.count("*").alias("_c"), F.sum(F.col("_n") * F.col("_times")).alias("_o"))
            .groupBy("site", "line_hash")
            .agg(F.sum("_n").alias("responses"), F.sum("_c").alias("clusters"), F.count("*").alias("days"), F.sum("_o").alias("occurrences"))
        )

    def repeated(self) -> DataFrame:
        responses, clusters_, days = self.least
        return self.counts().where((F.col("responses") >= responses) & (F.col("clusters") >= clusters_) & (F.col("days") >= days))

    def found_in_clusters(self) -> DataFrame:
        """``site, cluster, line_no`` of the repeated lines."""
        repeated = materialise(self.repeated(), "repeated-lines")
        total = repeated.agg(F.sum("occurrences")).first()[0] or 0
        hot = repeated.where(F.col("occurrences") * HOT_SHARE > total).select("site", "line_hash", F.lit(True).alias("_hot"))
        rest = repeated.where(F.col("occurrences") * HOT_SHARE <= total).select("site", "line_hash")
        marked = self.lines.join(F.broadcast(hot), ["site", "line_hash"], "left")  # at most HOT_SHARE rows
        cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(rest, ["site", "line_hash"], "left_semi")
        return marked.where(F.col("_hot")).drop("_hot").unionByName(cold).select("site", "cluster", "line_no")

    def found(self) -> DataFrame:
        """``response_id, line_no`` of each repeated line of each response.

        The copies of a document that is republished a great many times are dealt over
        ``SALTS`` tasks, each with the document's lines; there are at most ``HOT_SHARE`` such documents.
        """
        lines = materialise(self.found_in_clusters(), "found-lines")
        total = self.members.count()  # from the files' footers
        hot = self.members.groupBy("site", "cluster").agg(F.count("*").alias("_n")).where(F.col("_n") * HOT_SHARE > total).select("site", "cluster", F.lit(True).alias("_hot"))
        hot = F.broadcast(materialise(hot, "hot-documents"))
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("response_id"), F.lit(SALTS)).cast("int")).otherwise(0).alias("_salt")
        members = self.members.join(hot, ["site", "cluster"], "left").select("site", "cluster", "response_id", salt)
        salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        lines = lines.join(hot, ["site", "cluster"], "left").select("site", "cluster", "line_no", F.explode(salts).alias("_salt"))
        return members.join(lines, ["site", "cluster", "_salt"]).select("response_id", "line_no").distinct()

    def cleaned(self) -> DataFrame:
        """``response_id, text``: each document without its repeated lines. Documents without body keep a null text."""
        drop = self.found_in_clusters().groupBy("site", "cluster").agg(F.collect_set("line_no").alias("_drop"))
        keyed = self.documents.select("site", F.xxhash64("body", F.octet_length("body")).alias("cluster"), "response_id", "body")
        lines = F.split(utf8("body"), "\n")
        none = F.array().cast("array<int>")
        kept = F.filter(lines, lambda line, i: ~F.array_contains(F.coalesce("_drop", none), i + 1))
        return keyed.join(drop, ["site", "cluster"], "left").select("response_id", F.array_join(kept, "\n").alias("text"))
