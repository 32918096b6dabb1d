"""Pages from a transport: a Python data source with an injected fetch function, for networks and for tests."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.operators.crawl import body_hex, request_method

RESPONSE_SCHEMA = "url string, status int, reason string, headers map<string,string>, encoding string, method string, body binary"


def offline(url: str, options: dict) -> dict:
    """A transport without a network: nothing is found."""
    return {"status": 404, "reason": "Not Found", "headers": {}, "body": b""}


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class FetchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.urls = [u for u in self.options.get("urls", "").split("\n") if u]
        self.size = max(1, int(self.options.get("batch", "100")))

    def partitions(self) -> list[InputPartition]:
        return [Urls(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)]

    def read(self, partition: Urls) -> Iterator[tuple]:
        module, _, name = self.options.get("transport", "weftline.sources.fetch:offline").partition(":")
        fetch = getattr(importlib.import_module(module), name)
        retries = int(self.options.get("retries", "3"))
        for url in partition.urls if partition else ():
            answer: dict = {}
            for _ in range(max(1, retries)):
                try:
                    answer = fetch(url, self.options)
                    break
                except OSError as e:  # only the transport's errors are tried again
                    answer = {"status": None, "reason": str(e), "headers": {}, "body": None}
            yield url, answer.get("status"), answer.get("reason"), answer.get("headers", {}), answer.get("encoding"), self.options.get("method", "GET"), answer.get("body")


class FetchSource(DataSource):
    """``spark.read.format("weftline_fetch").option("urls", "a\\nb").option("transport", "module:function")``."""

    @classmethod
    def name(cls) -> str:
        return "weftline_fetch"

    def schema(self) -> str:
        return RESPONSE_SCHEMA

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options)


FETCHED_SCHEMA = "request_id long, url string, status int, reason string, headers map<string,string>, cookies map<string,string>, encoding string, method string, body binary"


def fetch_requests(requests: DataFrame, transport: str, retries: int = 3, keep_cookies: bool = False) -> DataFrame:
    """Responses of a table of requests, fetched where its rows lie: no url goes through the driver.

    ``requests``: ``request_id, url, sid, session_kwargs``; the kwargs give method, ``data`` or
    ``json`` and ``headers``. ``transport`` names a function that maps a dictionary ``url,
    method, headers, cookies, body`` to one ``status, reason, headers, cookies, encoding, body``. An
    ``OSError`` of it is tried again, and gives a null status in the end. With
    ``keep_cookies`` the cookies of each session and host are sent again within a partition.
    """
    headers = F.from_json(F.get_json_object("session_kwargs", "$.headers"), "map<string,string>")
    read = requests.select("request_id", "url", F.coalesce("sid", F.lit("")).alias("sid"), request_method("session_kwargs").alias("method"), F.unhex(body_hex("session_kwargs")).alias("body"), headers.alias("headers"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = transport.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        jar: dict[tuple[str, str], dict[str, str]] = {}
        for pdf in batches:
            rows = []
            for request_id, url, sid, method, body, headers_ in pdf.itertuples(index=False):
                key = (sid, urlsplit(url or "").netloc.lower())
                answer: dict = {}
                for _ in range(max(1, retries)):
                    try:
                        answer = fetch({"url": url, "method": method, "headers": dict(headers_ or ()), "cookies": dict(jar.get(key, {})), "body": body or b""})
                        break
                    except OSError as e:
                        answer = {"status": None, "reason": str(e)}
                cookies = answer.get("cookies") or {}
                if keep_cookies:
                    jar.setdefault(key, {}).update(cookies)
                rows.append((request_id, url, answer.get("status"), answer.get("reason"), answer.get("headers") or {}, cookies, answer.get("encoding"), method, answer.get("body")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED_SCHEMA.split(", ")]).astype({"status": "Int32"})

    return read.mapInPandas(scan, FETCHED_SCHEMA)
