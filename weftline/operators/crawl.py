"""Crawling as data flow: requests, the frontier, robots rules, filters, statistics, cache and checkpoints."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from weftline.functions import http
from weftline.functions.text import ColumnLike, col

MAX_BLOCKED_RETRIES = 3
REQUEST_SCHEMA = (
    "url string, sid string, priority int, dont_filter boolean, retry_count int, callback_name string, session_kwargs string, meta string, fingerprint string"
)


# --- requests --------------------------------------------------------------------


def make_requests(urls: DataFrame, sid: str = "", priority: int = 0, dont_filter: bool = False, callback: str | None = None) -> DataFrame:
    """Requests with default fields for a column ``url``."""
    return urls.select(
        "url", F.lit(sid).alias("sid"), F.lit(priority).alias("priority"), F.lit(dont_filter).alias("dont_filter"), F.lit(0).alias("retry_count"),
        F.lit(callback).cast("string").alias("callback_name"), F.lit("{}").alias("session_kwargs"), F.lit(None).cast("string").alias("meta"),
    )


def _member(kwargs: Column, name: str) -> tuple[Column, Column]:
    value = F.variant_get(F.try_parse_json(kwargs), f"$.{name}", "variant")
    return value, F.schema_of_variant(value) == "STRING"


def body_hex(kwargs: ColumnLike) -> Column:
    """The request's body in hex: ``data`` as it is or as JSON, else ``json`` as JSON, else empty."""
    data, is_text = _member(col(kwargs), "data")
    other, _ = _member(col(kwargs), "json")
    text = F.when(data.isNotNull() & is_text, data.cast("string")).when(data.isNotNull(), F.to_json(data)).when(other.isNotNull(), F.to_json(other))
    return F.coalesce(F.lower(F.hex(text.cast("binary"))), F.lit(""))


def request_method(kwargs: ColumnLike) -> Column:
    method, is_text = _member(col(kwargs), "method")
    return F.upper(F.when(is_text, method.cast("string")).otherwise("GET"))


def fingerprint(url: ColumnLike, sid: ColumnLike, kwargs: ColumnLike, include_kwargs: bool = False, include_headers: bool = False, keep_fragments: bool = False) -> Column:
    """SHA-1 in hex of compact JSON with the members body, headers, kwargs, method, sid and url, in this order.

    ``kwargs`` stands for the names of the session arguments only. Fragments are cut at
    the first ``#``; nothing else of the url is changed.
    """
    address = F.coalesce(col(url), F.lit(""))
    parts = [body_hex(kwargs).alias("body")]
    if include_headers:
        headers, _ = _member(col(kwargs), "headers")
        parts.append(F.when(headers.isNotNull(), F.to_json(headers)).alias("headers"))
    if include_kwargs:
        names = F.array_sort(F.coalesce(F.json_object_keys(col(kwargs)), F.array().cast("array<string>")))
        shown = F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", "), F.lit("]"))
        parts.append(F.lower(F.hex(shown.cast("binary"))).alias("kwargs"))
    parts += [request_method(kwargs).alias("method"), F.coalesce(col(sid), F.lit("")).alias("sid"), (address if keep_fragments else F.substring_index(address, "#", 1)).alias("url")]
    return F.sha1(F.to_json(F.struct(*parts)).cast("binary"))


def with_fingerprint(requests: DataFrame, **flags) -> DataFrame:
    """Keeps a fingerprint that is there (in lower case), works out the others."""
    worked = fingerprint("url", "sid", "session_kwargs", **flags)
    given = F.lower("fingerprint") if "fingerprint" in requests.columns else F.lit(None).cast("string")
    return requests.withColumn("fingerprint", F.coalesce(given, worked))


# --- frontier --------------------------------------------------------------------


def enqueue(requests: DataFrame, seen: DataFrame | None = None, order: str = "enqueue_no") -> DataFrame:
    """Requests that a scheduler accepts: the first of each fingerprint that isn't ``seen``, and all with ``dont_filter``.

    The first is found by aggregation with partial results, not by a window, so a
    fingerprint with a third of all rows doesn't meet in one task.
    """
    first = requests.groupBy("fingerprint").agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    if seen is not None:
        first = first.join(seen.select("fingerprint").distinct(), "fingerprint", "left_anti")
    marked = requests.join(first, ["fingerprint", order], "left")
    return marked.where(F.col("_first") | F.col("dont_filter")).drop("_first")


def snapshot(frontier: DataFrame, order: str = "enqueue_no") -> DataFrame:
    """Highest priority first, then in the order of arrival."""
    return frontier.orderBy(F.desc_nulls_last("priority"), F.asc(order))


def dequeue(frontier: DataFrame, count: int, order: str = "enqueue_no") -> DataFrame:
    """The next ``count`` requests: a top-k without a full sort."""
    return snapshot(frontier, order).limit(count)


def retry_blocked(requests: DataFrame, statuses: DataFrame, most: int = MAX_BLOCKED_RETRIES, blocked: Column | None = None) -> DataFrame:
    """Requests (``request_id``) with a blocked response, to be tried again at a lower priority."""
    blocked = statuses.where(http.is_blocked("status") if blocked is None else blocked).select("request_id").distinct()
    again = requests.where(F.coalesce("retry_count", F.lit(0)) < most).join(blocked, "request_id", "left_semi")
    return again.withColumns({"retry_count": F.coalesce("retry_count", F.lit(0)) + 1, "priority": F.col("priority") - 1, "dont_filter": F.lit(True)})


# --- filters ---------------------------------------------------------------------


def domain_allowed(url: ColumnLike, allowed: tuple[str, ...]) -> Column:
    """Host equal to an allowed domain or below it; no domains allow all."""
    if not allowed:
        return F.lit(True)
    h = http.host(url)
    out = F.lit(False)
    for d in allowed:
        out |= (h == d.lower()) | F.endswith(h, F.lit("." + d.lower()))
    return out


def domain_blocked(name: ColumnLike, blocked: tuple[str, ...]) -> Column:
    """Whether the host or a domain above it is in the set."""
    if not blocked:
        return F.lit(False)
    return F.arrays_overlap(http.host_suffixes(F.lower(col(name))), F.array(*[F.lit(b.lower()) for b in blocked]))


def blocked_requests(requests: DataFrame, blocked: DataFrame, kind: str = "resource_type", block_resources: bool = True) -> DataFrame:
    """Adds ``blocked``: a blocked resource type, or a host in or below a domain of the table ``blocked``.

    Hosts are exploded into their suffixes and joined once for each distinct host.
    """
    h = requests.withColumn("_host", http.host("url"))
    hosts = h.select("_host").where("_host != ''").distinct()
    hits = hosts.select("_host", F.explode(http.host_suffixes("_host")).alias("domain")).join(blocked.select(F.lower("domain").alias("domain")), "domain", "left_semi").select("_host").distinct()
    marked = h.join(hits.withColumn("_hit", F.lit(True)), "_host", "left")
    by_kind = http.should_block_resource(kind, block_resources) if kind in requests.columns else F.lit(False)
    return marked.withColumn("blocked", by_kind | F.coalesce("_hit", F.lit(False))).drop("_host", "_hit")


def robots_rules(robots: DataFrame) -> DataFrame:
    """``domain, disallowed, crawl_delay`` of ``domain, content``.

    Rules count while the last agent line named ``*`` exactly; empty Disallow lines fall
    away; the last readable Crawl-delay holds; lines that begin with ``#`` are skipped;
    keys are read in any letter case. Null contents have no rules.
    """
    lines = robots.select(F.lower("domain").alias("domain"), F.posexplode_outer(F.split("content", r"\r\n|\r|\n")).alias("no", "line"))
    line = F.trim(F.translate("line", "\t", " "))
    at = F.instr(line, ":")
    parts = lines.select("domain", "no", F.when(~F.startswith(line, F.lit("#")) & (at > 0), F.lower(F.trim(F.substring(line, F.lit(1), at - 1)))).alias("key"), F.trim(F.substring(line, at + 1, F.length(line))).alias("value"))
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("domain").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    ruled = parts.withColumn("_on", F.coalesce(agent == "*", F.lit(False)))
    rule = F.when(F.col("_on") & (F.col("key") == "disallow") & (F.col("value") != ""), F.struct("no", "value"))
    delay = F.when(F.col("_on") & (F.col("key") == "crawl-delay") & F.col("value").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.col("value").cast("double"))
    return ruled.groupBy("domain").agg(F.array_sort(F.collect_list(rule)).alias("_r"), F.max_by(delay, F.when(delay.isNotNull(), F.col("no"))).alias("crawl_delay")).select("domain", F.col("_r.value").alias("disallowed"), "crawl_delay")


def can_fetch(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``can_fetch``: no rule of the host is a prefix of the path. Hosts without rules and unreadable urls may be fetched."""
    h = requests.withColumn("_host", http.host("url"))
    joined = h.join(rules.select(F.col("domain").alias("_host"), "disallowed"), "_host", "left")
    hit = F.exists("disallowed", lambda rule: F.startswith(http.url_path("url"), rule))
    return joined.withColumn("can_fetch", ~F.coalesce(hit, F.lit(False))).drop("_host", "disallowed")


# --- statistics ------------------------------------------------------------------


def status_counts(responses: DataFrame) -> DataFrame:
    return responses.groupBy(F.concat(F.lit("status_"), F.coalesce(F.col("status").cast("string"), F.lit("none"))).alias("counter")).agg(F.count("*").alias("n"))


def domain_bytes(responses: DataFrame) -> DataFrame:
    return responses.groupBy(http.host("url").alias("domain")).agg(F.count("*").alias("responses"), F.sum(F.coalesce(F.octet_length("body"), F.lit(0)).cast("long")).alias("bytes"))


def session_counts(requests: DataFrame, default: str = "default") -> DataFrame:
    return requests.groupBy(F.coalesce(F.nullif("sid", F.lit("")), F.lit(default)).alias("sid")).agg(F.count("*").alias("requests"))


def crawl_rate(responses: DataFrame, at: str = "fetched_at") -> DataFrame:
    """One row: responses, elapsed seconds and responses a second (0 for no time)."""
    t = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    stats = responses.agg(F.count("*").alias("responses"), F.coalesce(F.max(t) - F.min(t), F.lit(0.0)).alias("elapsed_seconds"))
    return stats.withColumn("requests_per_second", F.when(F.col("elapsed_seconds") > 0, F.col("responses") / F.col("elapsed_seconds")).otherwise(0.0))


def level_counts(log: DataFrame, level: str = "level") -> DataFrame:
    """Messages by level; trace counts as debug."""
    name = F.lower(level)
    return log.groupBy(F.when(name == "trace", "debug").otherwise(name).alias("level")).agg(F.count("*").alias("n"))


# --- sessions and proxies --------------------------------------------------------


class SessionManager:
    """Named sessions; the first becomes the default."""

    def __init__(self):
        self.sessions: dict[str, object] = {}
        self.default: str | None = None

    def add(self, name: str, session: object, default: bool = False) -> None:
        if name in self.sessions:
            raise ValueError(f"session {name!r} exists")
        self.sessions[name] = session
        if self.default is None or default:
            self.default = name

    def get(self, name: str = "") -> object:
        if not self.sessions:
            raise LookupError("no session")
        return self.sessions[name or self.default]

    def __len__(self) -> int:
        return len(self.sessions)

    def __contains__(self, name: str) -> bool:
        return name in self.sessions


class ProxyRotator:
    """Hands out proxies in turn, or by a function ``(proxies, turn) -> index``."""

    def __init__(self, proxies: list[str], choose: Callable[[list[str], int], int] | None = None):
        if not proxies or len(set(proxies)) != len(proxies):
            raise ValueError("proxies must be given, each once")
        self.proxies, self.turn = list(proxies), 0
        self.choose = choose or (lambda p, turn: turn)

    def next(self) -> str:
        found = self.proxies[self.choose(self.proxies, self.turn) % len(self.proxies)]
        self.turn += 1
        return found

    def assign(self, requests: DataFrame, order: str = "enqueue_no") -> DataFrame:
        """Adds ``proxy`` by ``order`` modulo the number of proxies."""
        return requests.withColumn("proxy", F.element_at(F.array(*map(F.lit, self.proxies)), (F.pmod(F.col(order) - 1, F.lit(len(self.proxies))) + 1).cast("int")))


# --- cache and checkpoints -------------------------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; errors of the storage are raised, not taken for an absence."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def latest(table: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """``key, last`` with the fields of the row of greatest ``order`` for each key; ties go to the greatest fields, so that the answer is always the same."""
    kinds = dict(table.dtypes)
    ties = [F.to_json(F.struct(f)) if "map<" in kinds[f] or kinds[f] in ("binary", "variant") else F.col(f) for f in fields]
    return table.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(F.col(order).alias("_o"), *[t.alias(f"_t{i}") for i, t in enumerate(ties)])).alias("last"))


class ResponseCache:
    """Responses by fingerprint in a parquet table; the last one put for a key holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, responses: DataFrame) -> None:
        responses.withColumn("cached_at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def get(self, requests: DataFrame) -> DataFrame:
        """Requests with the cached response in ``cached`` (null for a miss)."""
        if not path_exists(self.spark, self.path):
            return requests.withColumn("cached", F.lit(None).cast("string"))
        table = self.spark.read.parquet(self.path)
        fields = [c for c in table.columns if c not in ("fingerprint", "cached_at")]
        last = latest(table, "fingerprint", "cached_at", *fields).withColumnRenamed("last", "cached")
        return requests.join(last, "fingerprint", "left")

    def clear(self) -> None:
        remove_path(self.spark, self.path)


class Checkpoint:
    """Frontier and seen fingerprints of a crawl, written under a new name and then named current.

    ``interval``: seconds from one checkpoint to the next; 0 writes one only for a pause.
    """

    def __init__(self, spark: SparkSession, path: str, interval: float = 0.0):
        if interval < 0:
            raise ValueError("the interval can't be negative")
        self.spark, self.path, self.interval = spark, path.rstrip("/"), interval

    def due(self, elapsed: float) -> bool:
        return self.interval > 0 and elapsed >= self.interval

    def save(self, frontier: DataFrame, seen: DataFrame, number: int, next_no: int = 0) -> None:
        frontier.write.mode("overwrite").parquet(f"{self.path}/{number:08d}/frontier")
        seen.select("fingerprint").write.mode("overwrite").parquet(f"{self.path}/{number:08d}/seen")
        self.spark.range(1).select(F.lit(number).alias("number"), F.lit(next_no).cast("long").alias("next_no")).coalesce(1).write.mode("append").json(f"{self.path}/done")

    def last(self) -> tuple[int, int] | None:
        """Number and next ``enqueue_no`` of the last complete checkpoint; null without one."""
        if not path_exists(self.spark, f"{self.path}/done"):
            return None
        row = self.spark.read.schema("number int, next_no long").json(f"{self.path}/done").agg(F.max(F.struct("number", "next_no")).alias("m")).first()
        return (row.m.number, row.m.next_no or 0) if row.m is not None and row.m.number is not None else None

    def load(self) -> tuple[DataFrame, DataFrame] | None:
        """The tables of the last complete checkpoint; null without one, or if one of them is gone."""
        last = self.last()
        if last is None:
            return None
        paths = [f"{self.path}/{last[0]:08d}/{name}" for name in ("frontier", "seen")]
        return tuple(map(self.spark.read.parquet, paths)) if all(path_exists(self.spark, p) for p in paths) else None

    def cleanup(self) -> None:
        remove_path(self.spark, self.path)


# --- robots files ----------------------------------------------------------------


def robots_urls(requests: DataFrame) -> DataFrame:
    """``domain, url`` of the robots file of each host asked for, once for each."""
    hosts = requests.select(http.host("url").alias("domain")).where("domain != ''").distinct()
    return hosts.select("domain", F.concat(F.lit("https://"), "domain", F.lit("/robots.txt")).alias("url"))


def fetch_robots(requests: DataFrame, fetch: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """``domain, content`` of the hosts that are not ``known`` yet; null content, which allows all, where the fetch gave no success."""
    asked = robots_urls(requests)
    if known is not None:
        asked = asked.join(known.select("domain"), "domain", "left_anti")
    got = fetch(asked.withColumn("request_id", F.xxhash64("domain"))).select("request_id", "status", "body")
    text = F.when(http.status_class("status") == "success", F.make_valid_utf8(F.col("body").cast("string")))
    return asked.withColumn("request_id", F.xxhash64("domain")).join(got, "request_id", "left").groupBy("domain").agg(F.max(text).alias("content"))


# --- requests as values ----------------------------------------------------------


def same_request(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that equal a row of ``b``: by fingerprint where both have one, else by url."""
    prints = a.where(F.col("fingerprint").isNotNull()).join(b.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct(), "fingerprint", "left_semi")
    bare = b.where(F.col("fingerprint").isNull()).select("url").distinct()
    by_url = a.where(F.col("fingerprint").isNotNull()).join(b.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct(), "fingerprint", "left_anti").join(bare, "url", "left_semi")
    loose = a.where(F.col("fingerprint").isNull()).join(b.select("url").distinct(), "url", "left_semi")
    return prints.select(*a.columns).unionByName(by_url.select(*a.columns)).unionByName(loose.select(*a.columns))


def without_callback(requests: DataFrame) -> DataFrame:
    """Copies without a callback; the fingerprint stays."""
    return requests.withColumn("callback_name", F.lit(None).cast("string"))


# --- the crawl in rounds ---------------------------------------------------------


@dataclass
class Spider:
    """What to crawl. ``parse`` maps fetched pages to links (``url``) and items (any columns).

    ``on_start`` and ``on_close`` get the result so far, ``on_error`` the failed responses of a
    round; ``blocked`` says by a Column which responses are blocked.
    """

    name: str
    start_urls: list[str]
    parse: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]
    allowed_domains: tuple[str, ...] = ()
    robots_obey: bool = True
    batch: int = 10_000
    max_rounds: int = 100
    on_item: Callable[[DataFrame], DataFrame] = lambda items: items
    on_start: Callable[[CrawlResult], None] = lambda result: None
    on_close: Callable[[CrawlResult], None] = lambda result: None
    on_error: Callable[[DataFrame], None] = lambda failed: None
    blocked: Callable[[], Column] = lambda: http.is_blocked("status")
    fingerprint_flags: dict[str, bool] = field(default_factory=dict)


@dataclass
class CrawlResult:
    stats: dict[str, int] = field(default_factory=dict)
    items: list[DataFrame] = field(default_factory=list)
    paused: bool = False
    stopped: bool = False
    rounds: int = 0


class CrawlEngine:
    """Runs a spider in rounds: each is one job from the next requests of the frontier to links and items.

    ``fetch`` maps requests to responses ``request_id, url, status, body``; offline it is a
    join with a table of pages. A request passes the robots rules, then the cache, then the
    fetch; what was fetched and isn't blocked goes into the cache. Each round's state is
    written below ``path``; it becomes a checkpoint when one is due and for a pause. A second
    request to pause stops the crawl without one. ``robots`` is a table ``domain, content``;
    without it the robots files are fetched once for each host.
    """

    def __init__(self, spark: SparkSession, spider: Spider, fetch: Callable[[DataFrame], DataFrame], path: str, robots: DataFrame | None = None, cache: ResponseCache | None = None, interval: float = 0.0):
        self.spark, self.spider, self.fetch, self.path, self.robots, self.cache = spark, spider, fetch, path, robots, cache
        self.checkpoint = Checkpoint(spark, f"{path}/checkpoint", interval)
        self.pause_requested = self.force_requested = False

    def request_pause(self) -> None:
        """The first call pauses after the round, with a checkpoint; the second stops at once."""
        self.force_requested, self.pause_requested = self.pause_requested, True

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written below the crawl's path and read again: fetched once, whatever is done with it."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _prepared(self, urls: DataFrame, next_no: int) -> DataFrame:
        """Requests numbered from ``next_no`` on; no later number is below those given here."""
        kept = urls.where(F.col("url").isNotNull() & domain_allowed("url", self.spider.allowed_domains)).select("url").distinct()
        numbered = with_fingerprint(make_requests(kept), **self.spider.fingerprint_flags).withColumn("enqueue_no", F.monotonically_increasing_id() + F.lit(next_no).cast("long"))
        return numbered.withColumn("request_id", F.col("enqueue_no"))

    def _responses(self, now: DataFrame, number: int, stats: dict[str, int]) -> DataFrame:
        """Responses of a round: from the cache, else fetched and, unless blocked, put into the cache."""
        if self.cache is None:
            return self._kept(self.fetch(now), f"responses/{number:08d}")
        asked = self._kept(self.cache.get(now), f"asked/{number:08d}")
        misses = asked.where(F.col("cached").isNull()).drop("cached")
        fetched = self._kept(self.fetch(misses), f"responses/{number:08d}")
        good = fetched.where(~self.spider.blocked()).join(misses.select("request_id", "fingerprint"), "request_id")
        self.cache.put(good.drop("request_id"))
        if isinstance(asked.schema["cached"].dataType, StructType):
            hits = asked.where(F.col("cached").isNotNull()).select("request_id", *[F.col("cached")[c].alias(c) for c in fetched.columns if c != "request_id"])
            stats["cached"] += hits.count()
            fetched = fetched.unionByName(hits)
        return fetched

    def _rules(self, now: DataFrame, known: DataFrame | None, number: int) -> DataFrame | None:
        """``domain, content`` known after this round's hosts were asked for."""
        if not self.spider.robots_obey or self.robots is not None:
            return self.robots if self.spider.robots_obey else None
        new = self._kept(fetch_robots(now, self.fetch, known), f"robots/{number:08d}")
        return new if known is None else known.unionByName(new)

    def crawl(self) -> CrawlResult:
        result = CrawlResult(stats={"requests": 0, "responses": 0, "blocked": 0, "robots_denied": 0, "cached": 0})
        spider = self.spider
        spider.on_start(result)
        restored = self.checkpoint.load()
        if restored:
            (frontier, seen), (number, next_no) = restored, self.checkpoint.last()
        else:
            start = self.spark.createDataFrame([(u,) for u in spider.start_urls], "url string")
            frontier = enqueue(self._prepared(start, 0))
            seen, number, next_no = frontier.select("fingerprint"), 0, 0
        robots, saved_at = None, time.monotonic()
        while result.rounds < spider.max_rounds:
            number += 1
            frontier, seen = self._kept(frontier, f"state/{number:08d}/frontier"), self._kept(seen, f"state/{number:08d}/seen")
            next_no = max(next_no, 1 + (frontier.agg(F.max("enqueue_no")).first()[0] or 0))
            if self.force_requested:
                result.stopped = True
                break
            if self.pause_requested or self.checkpoint.due(time.monotonic() - saved_at):
                self.checkpoint.save(frontier, seen, number, next_no)
                saved_at = time.monotonic()
            if self.pause_requested:
                result.paused = True
                break
            now = self._kept(dequeue(frontier, spider.batch), f"state/{number:08d}/now")
            size = now.count()
            if not size:
                break
            result.rounds += 1
            rest = frontier.join(now.select("fingerprint", "enqueue_no"), ["fingerprint", "enqueue_no"], "left_anti")
            robots = self._rules(now, robots, number)
            if robots is not None:
                now = can_fetch(now, robots_rules(robots))
                result.stats["robots_denied"] += now.where(~F.col("can_fetch")).count()
                now = now.where("can_fetch").drop("can_fetch")
            got = self._responses(now, number, result.stats)
            failed = got.where(spider.blocked())
            again = retry_blocked(now, got, blocked=spider.blocked())
            links, items = spider.parse(got.where(~spider.blocked()))
            result.stats["requests"] += size
            result.stats["responses"] += got.count()
            blocked = failed.count()
            result.stats["blocked"] += blocked
            if blocked:
                spider.on_error(failed)
            if items is not None:
                result.items.append(self._kept(spider.on_item(items), f"items/{number:08d}"))
            fresh = enqueue(self._prepared(links, next_no), seen)
            seen = seen.select("fingerprint").unionByName(fresh.select("fingerprint")).distinct()
            frontier = rest.unionByName(again.select(*rest.columns)).unionByName(fresh.select(*rest.columns))
        if not result.paused and not result.stopped:
            self.checkpoint.cleanup()
        spider.on_close(result)
        return result
