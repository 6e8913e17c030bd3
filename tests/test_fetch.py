"""Requests by host, packed answers, and the stream of pages over a server of its own."""

import gzip
import http.server
import io
import threading
import time
import zlib

import pytest

from eventloom.sources import fetch, page_stream, polite

ASKED: list[tuple[float, str]] = []


@pytest.fixture(scope="module")
def sites():
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ASKED.append((time.time(), f"{self.headers['Host']}{self.path}"))
            text = f"<p>page {self.path}</p>".encode()
            kind = self.path.rpartition(".")[2]
            packed = {"gz": gzip.compress(text), "zl": zlib.compress(text), "raw": zlib.compress(text)[2:-4], "bad": b"no gzip"}.get(kind, text)
            self.send_response(200)
            if kind in ("gz", "zl", "raw", "bad"):
                self.send_header("Content-Encoding", {"zl": "deflate", "raw": "deflate"}.get(kind, "gzip"))
            self.end_headers()
            self.wfile.write(packed)

        def log_message(self, *_):
            pass

    servers = [http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site) for _ in range(3)]
    for s in servers:
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield [f"http://127.0.0.1:{s.server_port}" for s in servers]
    for s in servers:
        s.shutdown()


def gaps(asked):
    by = {}
    for at, where in sorted(asked):
        by.setdefault(where.split("/")[0], []).append(at)
    return [b - a for ats in by.values() for a, b in zip(ats, ats[1:])]


def test_hosts_are_spaced_and_do_not_wait_for_each_other(spark, sites):
    ASKED.clear()
    urls = [f"{s}/{i}" for s in sites for i in range(4)]
    began = time.time()
    rows = list(polite.scheduled(urls, lambda u: fetch.page_row(u, fetch.http_get), pause=0.4, window=5))
    took = time.time() - began
    assert sorted(r[0] for r in rows) == sorted(urls) and all(r[4] for r in rows)
    assert min(gaps(ASKED)) >= 0.38 and took < 2.5 * 3 * 0.4  # three hosts of four pages side by side, not one after the other
    ASKED.clear()
    pages = fetch.fetched(spark.createDataFrame([(u,) for u in urls], "url string").repartition(3), pause=0.3).collect()
    assert len(pages) == 12 and min(gaps(ASKED)) >= 0.28


def test_schedule_of_odd_addresses():
    ask = lambda u: (u, time.monotonic())
    assert list(polite.scheduled([], ask)) == []
    got = list(polite.scheduled(iter([None, "", "http://[", "x", "x"]), ask, window=1, width=1))
    assert [u for u, _ in got] == [None, "", "http://[", "x", "x"]
    many = [f"http://h{i % 700}/{i}" for i in range(5_000)]
    assert sorted(u for u, _ in polite.scheduled(many, ask, window=100)) == sorted(many)
    first = next(iter(polite.scheduled(["http://a/"], ask, pause=0.2, wait_first=True)))[1]
    assert first > 0

    def fails(_):
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        list(polite.scheduled(["http://a/"] * 3, fails))


def test_packed_answers(sites):
    got = {u: fetch.page_row(f"{sites[0]}/{u}", fetch.http_get) for u in ("a.gz", "a.zl", "a.raw", "a.bad", "a")}
    assert all(got[u][3] == f"<p>page /{u}</p>" for u in ("a.gz", "a.zl", "a.raw", "a")) and got["a.bad"][4] is False
    bomb = gzip.compress(b"0" * 1_000_000)
    with pytest.raises(ValueError, match="more than"):
        fetch.body(io.BytesIO(bomb), "gzip", 10_000)
    assert fetch.body(io.BytesIO(bomb), "gzip", 1_000_000) == b"0" * 1_000_000 and fetch.body(io.BytesIO(b""), "gzip") == b""
    with pytest.raises(ValueError, match="unknown"):
        fetch.body(io.BytesIO(b"x"), "br")


def test_stream_asks_every_address_once(spark, sites, tmp_path):
    folder, out = tmp_path / "addresses", str(tmp_path / "out")
    folder.mkdir()

    def run():
        stream = page_stream.page_stream(spark, str(folder), maxAddresses=4, tasks=2, pause=0.05)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).format("parquet").start(out)
        want = sum(len([x for x in f.read_text().split("\n")[:-1] if x.strip()]) for f in folder.iterdir())
        until = time.time() + 90
        while time.time() < until and query.exception() is None and spark.read.schema(fetch.SCHEMA).parquet(out).count() < want:
            time.sleep(0.5)
        query.stop()
        assert query.exception() is None
        return sorted(r.url for r in spark.read.schema(fetch.SCHEMA).parquet(out).collect())

    ASKED.clear()
    first = [f"{s}/{i}" for s in sites for i in range(3)]
    (folder / "1.txt").write_text("\n".join([*first[:5], "", *first[5:]]) + "\n")
    assert run() == sorted(first)
    more = [f"{sites[0]}/more{i}" for i in range(5)]
    (folder / "1.txt").write_text((folder / "1.txt").read_text() + more[0] + "\n")
    (folder / "2.txt").write_text("\n".join(more[1:]) + "\nhttp://not.ended")
    assert run() == sorted(first + more)
    assert len(ASKED) == len(first + more) and min(gaps(ASKED)) >= 0.04
