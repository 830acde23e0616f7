"""Fetching of addresses in tasks: bounded redirects on allowed hosts, bodies that are never expanded past a cap.

A transport is a function from an address to ``{"status", "headers", "content", "url"}`` that
follows no redirect itself; what it talks to is its own affair.  ``fetch`` asks for a table of
addresses.  ``CaptureSource`` is a data source whose rows are the captures of the addresses that a
query's filter names: the filter is pushed down, and nothing else is asked for.
"""

from __future__ import annotations

import importlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Redirects that are followed, and bytes of a body, as sent or expanded (fixed values).
MOST_HOPS, MOST_BYTES = 3, 20 * 1024 * 1024
REDIRECTS = (301, 302, 303, 307, 308)
CAPTURE = "url string, final string, status int, headers map<string,string>, content binary, hops int, error string"


class Rejected(Exception):
    """Why an address has no capture."""


def expanded(content: bytes, cap: int = MOST_BYTES) -> bytes:
    """The members of a gzip body, expanded no further than ``cap`` bytes and one."""
    out, rest = b"", content
    while rest:
        member = zlib.decompressobj(16 + zlib.MAX_WBITS)
        try:
            out += member.decompress(rest, cap + 1 - len(out))
        except zlib.error as e:
            raise Rejected("not gzip") from e
        if len(out) > cap:
            raise Rejected("too large")
        if not member.eof:
            raise Rejected("gzip cut off")
        rest = member.unused_data
    return out


def allowed(url: str, hosts: frozenset[str]) -> bool:
    """Whether an address is https, on an allowed host, on the standard port, and names no user."""
    try:
        at = urlsplit(url)
        return at.scheme == "https" and at.hostname in hosts and at.port in (None, 443) and at.username is None and at.password is None
    except ValueError:
        return False


def capture(url: str, transport: Callable[[str], dict], hosts: frozenset[str], most: int = MOST_HOPS, cap: int = MOST_BYTES) -> tuple:
    """A row of ``CAPTURE``: every step of the way is checked before it is asked for."""
    at, hops, status = url, 0, None
    try:
        while True:
            if not allowed(at, hosts):
                raise Rejected("redirect not allowed" if hops else "address not allowed")
            got = transport(at)
            status, headers = int(got["status"]), {k.lower(): v for k, v in got["headers"].items()}
            if status in REDIRECTS:
                if hops == most:
                    raise Rejected("too many redirects")
                if not headers.get("location"):
                    raise Rejected("redirect without a target")
                at, hops = urljoin(at, headers["location"]), hops + 1
                continue
            if status != 200:
                raise Rejected(f"status {status}")
            content = got["content"]
            if len(content) > cap:
                raise Rejected("too large")
            if headers.get("content-encoding", "").strip().lower() in ("gzip", "x-gzip"):
                content = expanded(content, cap)
            return url, at, status, headers, content, hops, None
    except Rejected as e:
        return url, at, status, {}, None, hops, str(e)
    except Exception as e:  # whatever a transport raises concerns its address alone
        return url, at, status, {}, None, hops, f"transport: {type(e).__name__}"


def fetch(starts: DataFrame, transport: Callable[[str], dict], hosts: list[str], most: int = MOST_HOPS, cap: int = MOST_BYTES) -> DataFrame:
    """Captures of ``starts(url)``, each asked for once, in tasks; addresses that fail have an ``error`` and no content."""
    known = frozenset(hosts)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:
                yield pd.DataFrame([capture(url, transport, known, most, cap)], columns=[c.split()[0] for c in CAPTURE.split(", ")])

    return starts.select("url").where("url is not null").distinct().mapInPandas(ask, CAPTURE)


@F.pandas_udf(StructType([StructField("content", BinaryType()), StructField("error", StringType())]))
def gunzip(content: pd.Series, cap: pd.Series) -> pd.DataFrame:
    """Expanded bodies, or why not; null for null. Arrow."""
    out = []
    for body, most in zip(content, cap, strict=True):
        try:
            out.append((None if body is None else expanded(bytes(body), int(most)), None))
        except Rejected as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["content", "error"])


class _Addresses(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Captures(DataSourceReader):
    """A partition per host: one task asks a host for its addresses one after another."""

    def __init__(self, options: dict):
        self.options, self.urls = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) and f.attribute == ("url",) else set(f.value) if isinstance(f, In) and f.attribute == ("url",) else None
            if named is None:
                yield f  # Spark looks at these itself
            else:
                self.urls = named if self.urls is None else self.urls & named

    def partitions(self) -> list[InputPartition]:
        if self.urls is None:
            raise ValueError("captures are read by address: a filter has to name url")
        hosts: dict[str, list[str]] = {}
        for url in sorted(u for u in self.urls if u is not None):
            hosts.setdefault(url.split("/")[2] if url.count("/") > 1 else "", []).append(url)
        return [_Addresses(urls) for urls in hosts.values()] or [_Addresses([])]

    def read(self, partition: _Addresses) -> Iterator[tuple]:
        module, name = self.options["transport"].split(":")
        transport = getattr(importlib.import_module(module), name)
        hosts = frozenset(h.strip() for h in self.options["hosts"].split(","))
        for url in partition.urls:
            yield capture(url, transport, hosts, int(self.options.get("hops", MOST_HOPS)), int(self.options.get("bytes", MOST_BYTES)))


class CaptureSource(DataSource):
    """``captures``: a table that is loaded anew for every query, since Spark keeps the partitions of a loaded one.

    Options ``transport`` (``module:function``), ``hosts`` (comma-separated), ``hops`` and ``bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return CAPTURE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Captures(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format ``captures`` known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
