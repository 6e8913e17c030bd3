"""Queries against DuckDB on the smallest tables; plans, state, sink and stream on small fixtures."""

import collections
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.operators import select as O
from eventloom.operators.sink import credentials, deliver
from eventloom.functions import html as H
from eventloom.plans import collect as G
from eventloom.plans import search_plan as P
from eventloom.plans.verify import verify
from eventloom.queries import QUERIES, SQL
from eventloom.sources import feeds, registry, state
from eventloom.streaming.incremental import deliver_new, run_stream, state_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "pages", "documents", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = collections.Counter(tuple(r) for r in df.select(*names).collect())
    assert got
    if name in SQL:
        out = con.execute(SQL[name])
        cols = [c[0] for c in out.description]
        assert sorted(cols) == names
        assert got == collections.Counter(tuple(r[cols.index(n)] for n in names) for r in out.fetchall())


def test_dedupe_orders(spark):
    rows = spark.createDataFrame([("u1", 50, 0), ("u2", 60, 1), ("u1", 70, 2), ("u1", 70, 3)], "url string, s int, ord int")
    best = O.best_per_key(rows, F.col("url"), "s", "ord").orderBy("place").collect()
    assert [(r.url, r.s, r.ord, r.place) for r in best] == [("u1", 70, 2, 0), ("u2", 60, 1, 1)]
    assert sorted(r.ord for r in O.first_per_key(rows, F.col("url"), "ord").collect()) == [0, 1]


def test_collect_keeps_first_link_even_if_irrelevant(spark):
    held = lambda a: f"<section><div>{a}</div></section>"
    html = held('<a href="/t/1">Nothing</a>') + held('<a href="/t/1">OWASP meetup Pune</a>') + held('<a href="/t/2#x">OWASP meetup Pune</a>') + '<a href="http://[bad">x</a>'
    listings = spark.createDataFrame([(0, "https://a.org/list", "S", html, 200), (1, "https://b.org", "S", html, 404)], "ord int, url string, source string, html string, status int")
    assert [r.url for r in G.collect(listings).collect()] == ["https://a.org/t/2"]


def test_verify_marks_missing_pages(spark):
    html = '<title>OWASP Meetup Pune</title><p>Venue: Hall 1 Pune. Starts on March 5, 2026</p><a href="/r">Register</a>'
    out = {r.url: r for r in verify(spark.createDataFrame([("https://a.org/1", ""), ("https://a.org/2", "")], "url string, title string"), spark.createDataFrame([("https://a.org/1", html)], "url string, html string"), F.lit("2026-01-01").cast("date")).collect()}
    assert out["https://a.org/1"].score == 85 and out["https://a.org/1"].registration_url == "https://a.org/r"
    assert out["https://a.org/2"].score == 0 and not out["https://a.org/2"].reachable


def test_verify_reads_long_pages_whole(spark):
    html = f'<title>OWASP Meetup Pune</title><p>{"filler " * 4000}</p><p>Venue: Hall 1 Pune. Starts on March 5, 2026</p><a href="/r">Register</a>'
    assert len(H.parse(html)["text"]) > 28_000 and H.parse(html)["text"].endswith("Register")
    out = verify(spark.createDataFrame([("https://a.org/1", "")], "url string, title string"), spark.createDataFrame([("https://a.org/1", html)], "url string, html string"), F.lit("2026-01-01").cast("date")).first()
    assert out.score == 85 and out.detected_dates == ["05 March 2026"] and len(out.text) == 20_000


def test_feed_items(spark):
    xml = "<rss><channel><item><title>A &amp;lt;b&amp;gt; x</title><link>https://a.org</link><description>d</description><pubDate>p</pubDate></item><item><title></title><link>x</link></item></channel></rss>"
    assert [(r.pos, r.title, r.url) for r in feeds.feed_items(spark.createDataFrame([(1, xml)], "q int, xml string")).collect()] == [(0, "A x", "https://a.org")]
    assert P.feed_urls(spark.createDataFrame([("a b/c",)], "query string")).first().url.startswith("https://news.google.com/rss/search?q=a%20b/c&")


@pytest.mark.parametrize("body,want", [(None, []), ("[]", []), ('{"sent_urls":"x"}', []), ('{"sent_urls":[" a ",""]}', ["a"]), ("junk", [])])
def test_state_files(spark, tmp_path, body, want):
    p = tmp_path / "s.json"
    if body is not None:
        p.write_text(body)
    assert [r.url for r in state.load_state(spark, str(p)).collect()] == want


def test_registry(spark):
    assert registry.enabled(registry.sources(spark)).count() == 6 and P.search_plan_a(spark).count() == 328 and P.search_plan_b(spark).count() == 222 and P.feed_plan(spark).count() == 83
    assert state.state_document(spark.createDataFrame([("b",), ("a",), ("a",)], "url string")).first().value == '{"sent_urls":["a","b"]}'


def test_delivery_retries(monkeypatch):
    answers = iter([OSError(), {"ok": False}, {"ok": True}])

    def send(_):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert deliver("x", send, pause=0) and not deliver("x", lambda _: None, pause=0)
    monkeypatch.delenv("MESSAGE_TOKEN", raising=False)
    assert credentials() is None


def _events(spark):
    return spark.createDataFrame([(0, "a", "T", 80, True), (1, "b", "T", 90, True), (2, "a", "T", 95, True), (3, "c", "T", 70, False)], "ord int, url string, title string, verification_score int, is_today boolean")


def test_only_new_events_are_sent(spark, tmp_path):
    at = str(tmp_path / "state")
    got = []
    ok = lambda m: got.append(m) or {"ok": True}
    assert deliver_new(_events(spark), at, ok, 2, 0) == ["b", "a"] and len(got) == 2
    assert deliver_new(_events(spark), at, ok, 2, 0) == [] and state_table(spark, at).count() == 2


def test_stream(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "state")
    _events(spark).write.parquet(src)
    run_stream(spark.readStream.schema(_events(spark).schema).parquet(src), at, str(tmp_path / "ck"), lambda m: {"ok": True}, pause=0).awaitTermination()
    assert sorted(r.url for r in state_table(spark, at).collect()) == ["a", "b"] and os.path.isdir(at)


def test_gates_and_events_of_two_steps_are_those_of_all_signals(spark):
    from eventloom.functions import lexicon as L
    from eventloom.plans.corpus import AS_OF, corpus_sql
    from eventloom.plans.pipeline import gated, gates_and_events, verified_events
    from eventloom.plans.verify import decide, read_pages, signals
    from eventloom.queries import candidates_of, event_pages

    spark.range(4000).withColumnRenamed("id", "event_id").createOrReplaceTempView("two_steps")
    c = spark.sql(corpus_sql("spark", "two_steps").replace("varchar(9)", "string").replace("varchar(19)", "string"))
    today = F.lit(AS_OF).cast("date")
    rows = read_pages(candidates_of(c), event_pages(c)).localCheckpoint()
    full = gated(signals(rows, today), today).localCheckpoint()
    assert dict(map(tuple, decide(rows, today).select("ord", "gate").collect())) == dict(map(tuple, full.select("ord", "gate").collect()))
    gates, events = gates_and_events(candidates_of(c), event_pages(c), today)
    expected = verified_events(full.drop("is_today", "gate"), today)
    assert sorted(map(str, events.collect())) == sorted(map(str, expected.collect())) and events.count() > 10
    assert gates.where("gate = 'accepted'").count() == events.count() and gates.count() == 4000
    for terms in (["soc", "social", "so"], ["a.b", "a-c"], ["x"]):
        assert sorted(t for t in ["soc", "social", "so", "sonar", "s", "a.b", "axb", "a-c", "x"] if re.fullmatch(L.branched(terms), t)) == sorted(terms)
