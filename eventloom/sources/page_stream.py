"""Pages of a growing list of addresses as a stream: ``spark.readStream.format("web_page_stream").option("addresses", folder)``.

The list is a folder of text files, an address a line, on any file system that Arrow reaches; files are only added or
lengthened, and come in the order of their names. An offset is a file and the number of its lines that are done, so it stays
small however long the list grows, and a restarted query goes on where the checkpoint says: every address is asked once.

Options: ``maxAddresses``, at most so many in a micro-batch; ``pause``, the seconds between two requests of a host; ``tasks``,
into how many tasks a micro-batch is dealt, by host; ``timeout``. In a task hosts are asked side by side (``scheduled``),
so a page is fetched while others are being read. The rows are those of ``fetched``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow.fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from eventloom.sources.fetch import SCHEMA, TIMEOUT, http_get, page_row
from eventloom.sources.polite import host_of, scheduled

MOST, TASKS = 1_000, 8


class PageStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_page_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


class _Addresses(InputPartition):
    def __init__(self, urls: list[str], later: bool):
        self.urls, self.later = urls, later


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        lower = {k.lower(): v for k, v in options.items()}
        self.folder = lower["addresses"]
        self.most, self.tasks = int(lower.get("maxaddresses", MOST)), int(lower.get("tasks", TASKS))
        self.pause, self.timeout = float(lower.get("pause", 0)), float(lower.get("timeout", TIMEOUT))
        self.at: dict | None = None  # up to where micro-batches were given out

    def _lines(self, start: dict) -> Iterator[tuple[str, int, str]]:
        """(file, line number from 1, address) after an offset; blank lines and lines not ended yet are no addresses."""
        fs, path = arrow_fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (arrow_fs.LocalFileSystem(), self.folder)
        found = fs.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))
        for info in sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name):
            if info.base_name < start["file"]:
                continue
            with fs.open_input_stream(info.path) as f:
                for n, line in enumerate(f.read().split(b"\n")[:-1], 1):
                    if (info.base_name, n) > (start["file"], start["line"]) and line.strip():
                        yield info.base_name, n, line.decode("utf-8", "replace").strip()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "line": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = end = self.at or self.initialOffset()
        for n, (name, line, _) in enumerate(self._lines(self.at)):
            if n >= self.most:
                break
            end = {"file": name, "line": line}
        self.at = end
        return end

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(end, self.at or end, key=lambda o: (o["file"], o["line"]))
        last = (end["file"], end["line"])
        hosts: dict[str, list[str]] = {}
        for name, line, url in self._lines(start):
            if (name, line) > last:
                break
            hosts.setdefault(host_of(url), []).append(url)
        parts: list[list[str]] = [[] for _ in range(max(1, min(self.tasks, len(hosts))))]
        for urls in sorted(hosts.values(), key=len, reverse=True):
            min(parts, key=len).extend(urls)
        return [_Addresses(p, start["line"] > 0) for p in parts if p]

    def read(self, partition: _Addresses) -> Iterator[tuple]:
        yield from scheduled(partition.urls, lambda u: page_row(u, lambda x: http_get(x, self.timeout)), self.pause, wait_first=partition.later)


def page_stream(spark: SparkSession, addresses: str, **options: str | int | float) -> DataFrame:
    """The stream of the pages of a folder of addresses."""
    spark.dataSource.register(PageStream)
    return spark.readStream.format("web_page_stream").option("addresses", addresses).options(**options).load()
