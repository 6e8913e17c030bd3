"""Pages over HTTP, for runs that go to the network. A table of addresses is fetched by a map, a short list of them by a
Python data source; both give a row an address, whatever the answer was. Operators read the rows as any other table."""

from __future__ import annotations

import http.client
import json
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from eventloom.functions.urls import domain
from eventloom.sources.polite import WIDTH, scheduled

TIMEOUT = 20.0
MOST_BYTES = 50_000_000  # of a page, unpacked; a larger answer counts as one that cannot be read
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; eventloom/1.0)", "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9", "Accept-Encoding": "gzip, deflate"}
SCHEMA = "url string, final_url string, status int, html string, reachable boolean"
NAMES = ["url", "final_url", "status", "html", "reachable"]


def http_get(url: str, timeout: float = TIMEOUT) -> tuple[int, str, str]:
    """Status, address after redirects and text. Only web addresses are asked."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"not a web address: {url}")
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.geturl(), body(answer, answer.headers.get("Content-Encoding", "")).decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.geturl() or url, ""


def body(answer, packed: str, most: int = MOST_BYTES) -> bytes:
    """The bytes of an answer, unpacked as they come; ValueError beyond ``most``, or if they are not what they claim."""
    kinds = [k for k in packed.lower().replace(" ", "").split(",") if k not in ("", "identity")]
    if len(kinds) > 1 or (kinds and kinds[0] not in ("gzip", "x-gzip", "deflate")):
        raise ValueError(f"unknown encoding: {packed}")
    out, size, unpack = [], 0, None
    while part := answer.read(65_536):
        if kinds and unpack is None:  # deflate comes with a header, or raw
            raw = kinds[0] == "deflate" and not (part[0] & 15 == 8 and int.from_bytes(part[:2], "big") % 31 == 0)
            unpack = zlib.decompressobj(-zlib.MAX_WBITS if raw else zlib.MAX_WBITS | 32)
        while part:
            try:
                got = unpack.decompress(part, most - size + 1) if unpack else part
            except zlib.error as e:
                raise ValueError(str(e)) from e
            part = unpack.unconsumed_tail if unpack else b""
            out.append(got)
            size += len(got)
            if size > most:
                raise ValueError(f"more than {most} bytes")
    return b"".join(out)


def page_row(url: str | None, get: Callable[[str], tuple[int, str, str]]) -> tuple:
    """The row of an address: an error or an error status is not reachable and keeps the address that was asked."""
    try:
        status, final, text = get(url or "")
    except (OSError, ValueError, LookupError, http.client.HTTPException):
        return url, url, None, None, False
    good = status < 400
    return url, final if good else url, status, text if good else None, good


def fetched(urls: DataFrame, get: Callable[[str], tuple[int, str, str]] = http_get, pause: float = 0.0, width: int = WIDTH) -> DataFrame:
    """The page of each distinct ``url``. Addresses of a host stay in one task, which keeps ``pause`` between its requests
    and meanwhile asks other hosts, up to ``width`` at once. An executor's loss asks its addresses again: write the rows
    before they are read twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for row in scheduled((u for frame in frames for u in frame["url"]), lambda u: page_row(u, get), pause, width):
            rows.append(row)
            size += len(row[3] or "")
            if len(rows) >= 200 or size >= 4_000_000:
                yield pd.DataFrame(rows, columns=NAMES).astype({"status": "Int32"})
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=NAMES).astype({"status": "Int32"})

    asked = urls.select("url").where(F.col("url").isNotNull()).distinct()
    return asked.repartition(domain(F.col("url"))).mapInPandas(run, SCHEMA)


def listings(pages: DataFrame) -> DataFrame:
    """Fetched pages as listings: only status 200 has text."""
    return pages.withColumn("html", F.when(F.col("status") == 200, F.col("html")))


class PageSource(DataSource):
    """``spark.read.format("web_pages").option("urls", json list)``: a partition an address."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(json.loads(self.options.get("urls", "[]")), float(self.options.get("timeout", TIMEOUT)))


class _PageReader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float):
        self.urls, self.timeout = urls, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield page_row(partition.value, lambda u: http_get(u, self.timeout))


def web_pages(spark: SparkSession, urls: list[str]) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format("web_pages").option("urls", json.dumps(urls)).load()
