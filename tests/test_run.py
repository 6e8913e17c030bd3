"""Fetching over HTTP, reports, the state file, the whole run and the command line."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from eventloom import __main__ as cli
from eventloom.functions import classify as C
from eventloom.functions import dates as D
from eventloom.functions import html as H
from eventloom.functions import text as T
from eventloom.functions import urls as U
from eventloom.operators import report, sink
from eventloom.plans.run import run_pipeline
from eventloom.sources import fetch, registry, state
from eventloom.streaming.incremental import first_seen

TODAY = "2026-03-05"
EVENT = '<title>OWASP Meetup Pune</title><meta name="description" content="A meetup."><p>Venue: Hall 1 Pune. Starts on March 5, 2026</p><a href="/r">Register</a>'


@pytest.fixture(scope="module")
def site():
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/page")
                self.end_headers()
                return
            self.send_response({"/page": 200, "/made": 201}.get(self.path, 404))
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write("<p>é</p>".encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, site):
    urls = [f"{site}/page", f"{site}/moved", f"{site}/made", f"{site}/none", "http://127.0.0.1:9/", "file:///etc/hosts", None]
    want = {
        f"{site}/page": (f"{site}/page", 200, "<p>é</p>", True), f"{site}/moved": (f"{site}/page", 200, "<p>é</p>", True), f"{site}/made": (f"{site}/made", 201, "<p>é</p>", True),
        f"{site}/none": (f"{site}/none", 404, None, False), "http://127.0.0.1:9/": ("http://127.0.0.1:9/", None, None, False), "file:///etc/hosts": ("file:///etc/hosts", None, None, False),
    }
    pages = fetch.fetched(spark.createDataFrame([(u,) for u in urls + urls[:1]], "url string"))
    assert {r.url: tuple(r)[1:] for r in pages.collect()} == want
    assert {r.url: r.html for r in fetch.listings(pages).collect()}[f"{site}/made"] is None
    assert {r.url: tuple(r)[1:] for r in fetch.web_pages(spark, urls[:4]).collect()} == {u: want[u] for u in urls[:4]}
    assert fetch.fetched(spark.createDataFrame([], "url string")).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([(2, "B", "s", "d", "u2"), (1, "A", "s", "d", "u1")], "n int, title string, source string, description string, url string")
    assert tuple(report.sizes(rows, rows.limit(1)).first()) == (2, 1) and tuple(report.sizes(rows.limit(0), rows.limit(0)).first()) == (0, 0)
    assert [tuple(r) for r in report.candidate_lines(rows, "n").orderBy("number").collect()] == [(1, "[1] A\n    Source: s\n    d\n    URL: u1"), (2, "[2] B\n    Source: s\n    d\n    URL: u2")]
    assert report.candidate_lines(rows, "n", 1).count() == 1
    results = spark.createDataFrame([("a", "sent"), ("", "failed"), ("b", "blocked"), ("c", "failed")], "url string, status string")
    assert tuple(report.delivery_counts(results).first()) == (4, 1, 2, 1)
    assert json.loads(report.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first().value) == {"a": 1, "b": None}


def test_send_guards(spark):
    rows = spark.createDataFrame([(0, "a", "T", True), (1, " ", "T", True), (2, "b", "T", False), (3, "c", "T", None), (4, "d", "Zork", True)], "ord int, url string, title string, is_today boolean")
    got = dict(sink.delivery_results(rows, lambda m: {"ok": "Zork" not in m}, pause=0))
    assert got == {"a": "sent", "": "failed", "b": "blocked", "c": "blocked", "d": "failed"}


def test_state_file(spark, tmp_path):
    urls = spark.createDataFrame([("https://b.org/é",), ("https://a.org",), ("https://a.org",)], "url string")
    path = str(tmp_path / "deep" / "sent.json")
    assert state.write_state(urls, path) and open(path, encoding="utf-8").read() == '{\n  "sent_urls": [\n    "https://a.org",\n    "https://b.org/é"\n  ]\n}'
    assert sorted(r.url for r in state.load_state(spark, path).collect()) == ["https://a.org", "https://b.org/é"]
    (tmp_path / "file").write_text("")
    assert not state.write_state(urls, str(tmp_path / "file" / "sent.json"))


def test_lookups(spark):
    assert registry.source_by_key(registry.sources(spark), "null").first().name == "Null Community" and registry.source_by_key(registry.sources(spark), "x").count() == 0
    rows = spark.createDataFrame([("Event LISTING page",), ("index",), ("a category",), ("Event date is in the past",), (None,)], "r string")
    assert [r[0] for r in rows.select(C.is_listing_reason(F.col("r"))).collect()] == [True, True, True, False, False]
    one = spark.range(1).select(T.title_case(F.lit("capture the flag")), U.cut_fragment(F.lit(" https://a.org/x#y ")), D.today_in("Asia/Kolkata")).first()
    assert one[0] == "Capture The Flag" and one[1] == "https://a.org/x" and one[2] is not None


def test_first_seen_forgets_after_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 00:00:00", "a"), ("2026-01-02 00:00:00", "a"), ("2026-01-02 00:00:00", "b")], "t string, url string").select(F.col("t").cast("timestamp").alias("t"), "url")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(src)
    first_seen(spark.readStream.schema(rows.schema).parquet(src), "t").writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).format("parquet").start(out).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_html_in_linear_time_and_odd_pages():
    assert H.parse(None)["text"] == "" and H.parse("<p>a<p>b")["text"] == "a b" and H.parse("</b><i>x")["text"] == "x"
    nested = H.parse("<ul><li><a href=/1>one <b>two</b></a> x<li><a href=/2><a href=/3>three</a></ul>rest")
    assert [(x["href"], x["text"]) for x in nested["links"]] == [("/1", "one two"), ("/2", "three"), ("/3", "three")] and nested["links"][0]["context"] == "one two x three"
    many = H.parse("<div>" + "".join(f"<p><a href=/{i}>x</a></p>" for i in range(30_000)) + "<b>" * 30_000 + "</i>" * 30_000)
    assert len(many["links"]) == 30_000


def run_once(spark, send, sent=(), state_path=None):
    link = "".join(f'<section><div><a href="/t/{i}">OWASP Meetup Pune {i}</a></div></section>' for i in range(14))
    listings = spark.createDataFrame([("https://owasp.org/events/", 200, link), ("https://owasp.org/chapters/", 200, link), ("https://null.community/", 404, link)], "url string, status int, html string")
    pages = spark.createDataFrame([(f"https://owasp.org/t/{i}", EVENT if i else "<p>nothing</p>") for i in range(13)], "url string, html string")
    known = spark.createDataFrame([(u,) for u in sent], "url string")
    return run_pipeline(spark, listings, pages, known, F.lit(TODAY).cast("date"), send, state_path, pause=0)


def test_run(spark, tmp_path):
    path = str(tmp_path / "sent.json")
    run = run_once(spark, lambda m: {"ok": "Pune 3" not in m}, ["https://owasp.org/t/1"], path)
    assert tuple(run.sizes.first()) == (28, 14) and {r.gate: r.n for r in run.gates.collect()} == {"accepted": 12, "low score": 1, "unreachable": 1}
    assert len(run.events.columns) == 30 and run.events.count() == 12
    one = run.events.where("url = 'https://owasp.org/t/5'").first()
    assert (one.title, one.page_title, one.source, one.event_description, one.registration_url, one.event_url) == ("OWASP Meetup Pune 5", "OWASP Meetup Pune", "OWASP", "A meetup.", "https://owasp.org/r", "https://owasp.org/t/5")
    assert one.description == "Detected location: Pune Platform: Other" and one.is_today and one.detected_dates == ["05 March 2026"]
    assert tuple(run.deliveries.first()) == (10, 9, 1, 0) and len(run.sent) == 9 and "https://owasp.org/t/3" not in run.sent
    assert sorted(r.url for r in state.load_state(spark, path).collect()) == sorted([*run.sent, "https://owasp.org/t/1"])
    again = run_once(spark, lambda m: {"ok": True}, [r.url for r in state.load_state(spark, path).collect()], path)
    assert sorted(again.sent) == ["https://owasp.org/t/12", "https://owasp.org/t/3"]
    assert run_once(spark, lambda m: {"ok": True}, [f"https://owasp.org/t/{i}" for i in range(14)]).sent == []


def test_command_line(spark, capsys):
    feed = "<rss><channel><item><title>OWASP Meetup Pune</title><link>https://owasp.org/x</link><description>infosec event</description></item></channel></rss>"
    assert cli.main(["discover"], lambda u: (200, u, feed)) == 0 and "1 events" in capsys.readouterr().out
    assert cli.main(["verify", "https://a.org/1"], lambda u: (200, u, EVENT)) == 0 and json.loads(capsys.readouterr().out)["event_location"].startswith("Venue: Hall 1 Pune")
    assert cli.main(["probe"], lambda u: (200, u, "xy")) == 0 and capsys.readouterr().out.count("accessible") == 5
    assert cli.main([]) == 1 and cli.main(["verify"]) == 1

    def interrupted(*_):
        raise KeyboardInterrupt

    with pytest.MonkeyPatch.context() as m:
        m.setattr(cli, "discover", interrupted)
        assert cli.main(["discover"]) == 130
        m.setattr(cli, "discover", lambda *_: 1 / 0)
        assert cli.main(["discover"]) == 1
