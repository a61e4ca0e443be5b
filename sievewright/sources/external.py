"""Interfaces to systems outside Spark, with stubs for tests and offline runs."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.arrow import hashing_embedder


class Embedder(Protocol):
    """Text column to vector column."""

    dimensions: int

    def __call__(self, text): ...


class Completion(Protocol):
    """A prompt to a text; runs on executors, one client a partition."""

    def __call__(self, prompt: str) -> str: ...


def complete(rows: DataFrame, prompt: str, make_client: Callable[[], Completion], out: str = "completion", attempts: int = 3) -> DataFrame:
    """``rows`` with a model's answer, or null after ``attempts`` failures."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            answers = []
            for text in frame[prompt]:
                answer = None
                for _ in range(attempts):
                    try:
                        answer = client(text)
                        break
                    except OSError:
                        continue
                answers.append(answer)
            yield frame.assign(**{out: answers})

    return rows.mapInPandas(run, schema)


def embed(rows: DataFrame, text: str, out: str = "vector", embedder=None) -> DataFrame:
    return rows.withColumn(out, (embedder or hashing_embedder())(F.col(text)))


def public_address(url: str) -> bool:
    """https, and no local host, nor a host that is or resolves to an address that isn't global."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme != "https" or not host or host.rstrip(".").lower() in ("localhost", "localhost.localdomain") or host.rstrip(".").lower().endswith(".localhost"):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        pass
    try:
        found = {x[4][0] for x in socket.getaddrinfo(host, parts.port or 443)}
    except (OSError, ValueError):
        return True  # the request itself will fail, and say why
    return all(ipaddress.ip_address(a.partition("%")[0]).is_global for a in found)


class FetchSource(DataSource):
    """One row a URL: status, body and error as data; one partition a URL.

    Options: ``urls`` (separated by spaces), ``timeout``, ``limit`` (bytes).
    Only public https addresses are fetched, redirects included; a failure is
    a row, never an exception.
    """

    @classmethod
    def name(cls) -> str:
        return "sievewright_fetch"

    def schema(self) -> str:
        return "url string, status int, body binary, error string"

    def reader(self, schema):
        return _FetchReader(self.options)


class _FetchReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.timeout, self.limit = options.get("urls", "").split(), float(options.get("timeout", "20")), int(options.get("limit", "3000000"))

    def partitions(self):
        return [InputPartition(u) for u in self.urls] or [InputPartition("")]

    def read(self, partition):
        from urllib.error import HTTPError
        from urllib.request import HTTPRedirectHandler, build_opener

        class Checked(HTTPRedirectHandler):
            """Follows a redirect only to a public https address."""

            def redirect_request(self, req, fp, code, msg, headers, newurl):
                if not public_address(newurl):
                    raise ValueError("redirected to an address that is not public")
                return super().redirect_request(req, fp, code, msg, headers, newurl)

        url = partition.value
        if not url:
            return
        if not public_address(url):
            yield url, None, None, "not a public https address"
            return
        try:
            with build_opener(Checked()).open(url, timeout=self.timeout) as answer:
                body = answer.read(self.limit + 1)
                yield (url, answer.status, None, "too large") if len(body) > self.limit else (url, answer.status, body, None)
        except HTTPError as e:
            yield url, e.code, None, str(e)
        except (OSError, ValueError) as e:
            yield url, None, None, str(e)
