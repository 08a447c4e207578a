"""Live fetching: of a table of addresses, or as a data source, ``spark.read.format("guarded_http")``. Responses are normally read from captured tables."""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from crawlvis.functions.net import BLOCKED_V4
from crawlvis.operators.responses import FETCH_MS, MAX_BODY_BYTES, MAX_REDIRECTS, REDIRECTS

SCHEMA = "requested_url string, host string, final_url string, status int, content_type string, bytes long, html string, redirects array<string>, duration_ms long, error_type string"
BLOCKED = [ipaddress.ip_network(f"{base}/{bits}") for base, bits in BLOCKED_V4]
#: Addresses of a host that a partition of the data source asks for, one after another.
URLS_PER_PARTITION = 20


def is_private(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    """As ``functions.net.is_private``: the blocked IPv4 ranges, also inside IPv6, and loopback, unique local, link local and NAT64 addresses."""
    if address.version == 4:
        return any(address in network for network in BLOCKED)
    n = int(address)
    if n in (0, 1):
        return True
    if n >> 32 in (0, 0xFFFF):
        return is_private(ipaddress.IPv4Address(n & 0xFFFFFFFF))
    first = n >> 112
    return 0xFC00 <= first <= 0xFDFF or 0xFE80 <= first <= 0xFEBF or n >> 96 == 0x0064FF9B


def _asked(parts, address: str, agent: str, timeout: float) -> http.client.HTTPResponse:
    """The response of the host at just that address, so that its name isn't looked up again."""
    port = parts.port or (443 if parts.scheme == "https" else 80)
    link = http.client.HTTPConnection(parts.hostname, port, timeout=timeout)
    link.sock = socket.create_connection((address, port), timeout=timeout)
    if parts.scheme == "https":
        link.sock = ssl.create_default_context().wrap_socket(link.sock, server_hostname=parts.hostname)
    target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    link.request("GET", target, headers={"Host": parts.netloc.rpartition("@")[2], "User-Agent": agent, "Accept": "text/html,*/*", "Connection": "close"})
    return link.getresponse()


def resolved(host: str) -> list[str]:
    """The addresses of a host, those of IPv4 first."""
    return sorted({a[4][0].partition("%")[0] for a in socket.getaddrinfo(host, None)}, key=lambda a: ":" in a)


class Names:
    """Addresses of hosts, each looked up once; a failure is kept as well."""

    def __init__(self, lookup: Callable[[str], list[str]] = resolved):
        self.lookup, self.known = lookup, {}

    def __call__(self, host: str) -> list[str]:
        if host not in self.known:
            try:
                self.known[host] = self.lookup(host)
            except OSError as error:
                self.known[host] = error
        if isinstance(self.known[host], OSError):
            raise self.known[host]
        return self.known[host]


def fetch(url: str, agent: str, budget_ms: int = FETCH_MS, allow_local: bool = False, names: Callable[[str], list[str]] = resolved, wanted: Callable[[int], bool] = lambda status: True) -> tuple:
    """One response as a row; what goes wrong is its error_type.

    Every hop's addresses are checked before it is asked, and it is asked at one that was checked. All hops and the
    body share one budget of time. The body of a response whose status isn't ``wanted`` is not read.
    """
    began, redirects, at = time.monotonic(), [], url

    def row(status=None, kind=None, body=b"", error=None):
        return url, host_of(url), at, status, kind, len(body), body.decode("utf-8", "replace"), redirects, int((time.monotonic() - began) * 1000), error

    def left() -> float:
        rest = budget_ms / 1000 - (time.monotonic() - began)
        if rest <= 0:
            raise TimeoutError
        return rest

    while True:
        try:
            parts = urlsplit(at)
            if parts.scheme not in ("http", "https") or not parts.hostname:
                return row(error="ssrf_blocked" if parts.scheme not in ("http", "https") else "dns_or_network")
            found = names(parts.hostname)
            if not found or not allow_local and any(is_private(ipaddress.ip_address(a)) for a in found):
                return row(error="ssrf_blocked" if found else "dns_or_network")
            with _asked(parts, found[0], agent, left()) as answer:
                target = answer.headers.get("location")
                if answer.status in REDIRECTS and target:
                    if len(redirects) >= MAX_REDIRECTS:
                        return row(error="dns_or_network")
                    redirects.append(at)
                    at = urljoin(at, target)
                    continue
                body = b""
                while wanted(answer.status) and len(body) < MAX_BODY_BYTES and (piece := answer.read1(min(65536, MAX_BODY_BYTES - len(body)))):
                    body += piece
                    left()
                return row(answer.status, answer.headers.get("content-type"), body)
        except TimeoutError:
            return row(error="timeout")
        except (OSError, ValueError, http.client.HTTPException):
            return row(error="dns_or_network")


def host_of(url: str) -> str | None:
    """The host that an address names; null where it can't be read."""
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


def fetched(requests: DataFrame, *, allow_local: bool = False) -> DataFrame:
    """The responses of a table of url and agent, asked for where its rows lie: partitions of the table are the scans that run at once."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Names()
        for batch in batches:
            for url, agent in zip(batch.url, batch.agent, strict=True):
                yield pd.DataFrame([fetch(url, agent, allow_local=allow_local, names=known)], columns=names)

    return requests.select("url", "agent").mapInPandas(ask, SCHEMA)


@dataclass
class Asked(InputPartition):
    """Addresses of one host."""

    urls: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options["urls"].split("\n") if u]
        self.agent, self.allow_local = options.get("agent", "GPTBot/1.0"), options.get("allowLocal", "false") == "true"
        self.statuses: list[list[int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Hosts that aren't wanted aren't asked, and of responses with other statuses no body is read. What isn't pushed goes back to Spark."""
        for f in filters:
            column, values = getattr(f, "attribute", ()), [f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and column == ("host",):
                self.urls = [u for u in self.urls if host_of(u) in values]
            elif values is not None and column == ("status",):
                self.statuses.append(list(values))
            else:
                yield f

    def wanted(self, status: int | None) -> bool:
        return all(status in values for values in self.statuses)

    def partitions(self) -> list[Asked]:
        hosts: dict[str | None, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(host_of(u), []).append(u)
        return [Asked(urls[i : i + URLS_PER_PARTITION]) for urls in hosts.values() for i in range(0, len(urls), URLS_PER_PARTITION)] or [Asked([])]

    def read(self, partition: Asked) -> Iterator[tuple]:
        names = Names()
        for url in partition.urls:
            row = fetch(url, self.agent, allow_local=self.allow_local, names=names, wanted=self.wanted)
            if self.wanted(row[3]):
                yield row


class GuardedHttp(DataSource):
    """Options: urls, one on each line; agent; allowLocal. A partition holds addresses of one host, which it looks up once.

    With ``spark.sql.python.filterPushdown.enabled``, equalities of host and status go to the source.
    """

    @classmethod
    def name(cls) -> str:
        return "guarded_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)
