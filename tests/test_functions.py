"""Golden cases of the functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.functions import classify as C
from eventloom.functions import dates as D
from eventloom.functions import html as H
from eventloom.functions import lexicon as L
from eventloom.functions import message as M
from eventloom.functions import scoring as S
from eventloom.functions import text as T
from eventloom.functions import urls as U

lit = F.lit


def check(spark, cases):
    """cases: name -> (column, expected); all in one row."""
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases.values())]).first()
    wrong = {n: (row[i], want) for i, (n, (_, want)) in enumerate(cases.items()) if row[i] != want}
    assert not wrong


def test_dates(spark):
    parse = {
        "2026-03-05T10:00": "05 March 2026", "March 5, 2026": "05 March 2026", "5 March 2026": "05 March 2026", "March 5 2026": "", "OCTOBER 5, 2026": "", "03/04/2026": "03 April 2026",
        "04/13/2026": "13 April 2026", "03/04/26": "03 April 2026", "03/04/75": "03 April 1975", "03-04-26": "", "2026-02-30": "", "N/A": "", "": "",
    }
    check(spark, {v: (D.date_text(lit(v)), want) for v, want in parse.items()})
    dates = lambda *x: F.array(*map(lit, x)) if x else F.array().cast("array<string>")
    day = lit("2026-01-05").cast("date")
    check(spark, {
        "all": (D.all_dates(lit("Starts 5 March 2026 and March 7, 2026")), ["07 March 2026", "05 March 2026"]),
        "end before": (D.sane_end(lit("05 March 2026"), lit("01 March 2026")), ""), "end 36": (D.sane_end(lit("05 March 2026"), lit("10 April 2026")), ""), "end 31": (D.sane_end(lit("05 March 2026"), lit("05 April 2026")), "05 April 2026"),
        "covers": (D.covers(dates("01 January 2026", "10 January 2026"), day), True), "none": (D.covers(dates(), day), False), "junk": (D.covers(dates("junk"), day), False),
        "whole": (D.parse_whole(lit("5 Mar 2026")), dt.date(2026, 3, 5)), "may": (D.parse_whole(lit("5 May 2026")), dt.date(2026, 5, 5)),
        "clock": (D.clock(lit("2026-03-05T09:30:00"), lit("at 7 pm")), "09:30"), "clock text": (D.clock(lit(""), lit("at 7 pm")), "7 pm"),
        "page dates": (D.detected_dates(lit(""), lit(""), dates(*"abcdefg")), list("abcde")), "range": (D.date_range(lit("a"), lit("b")), "a – b"), "no range": (D.date_range(lit(""), lit("b")), "Not specified"),
    })


def test_places_and_kinds(spark):
    check(spark, {
        **{f"collect {v}": (C.city_collect(lit(v)), w) for v, w in {"Meetup in New Delhi": "Delhi", "Bangalore": "Bengaluru", "Gurgaon": "Gurgaon", "Indianapolis": "Unknown", "virtual": "Online"}.items()},
        "rss": (C.city_rss(lit("Indianapolis")), "India"), "state": (C.state_lex(lit("our goal")), "Goa"), "state of city": (C.state_of_city(lit("mysore")), "Karnataka"),
        "foreign": (C.foreign_place(lit("in the United States of America")), "united states of america"), "no foreign": (C.foreign_place(lit("Lukla")), ""), "dotted": (C.foreign_place(lit("in the U.S. today")), "u.s."),
        "hybrid": (C.mode_of(lit("online and in-person"), lit("")), "Hybrid"), "online": (C.mode_of(lit("join on zoom"), lit("")), "Online"), "offline": (C.mode_of(lit("hall 2"), lit("")), "Offline"),
        "trap price": (C.price_of_page(lit(""), lit(""), lit("24 speakers 12 talks")), "rs 12"), "free": (C.price_of_page(lit(""), lit(""), lit("Members, free event")), "Free"), "no price": (C.price_of_page(lit(""), lit(""), lit("nothing")), "Not specified"),
        "zero": (C.price_of_page(lit("0"), lit("INR"), lit("")), "INR 0"), "word boundary": (C.has_foreign_signal(lit("in the U.S. today")), False), "strong": (C.is_strong_topic(lit("social evening"), lit("")), True),
        "title": (C.title_of_page(lit("Meetup"), lit("Event: Night of Hacks")), "Night of Hacks"), "listing": (C.is_listing(lit("All Events"), lit(""), lit(False), lit(""), lit("")), True),
    })


def test_urls(spark):
    redirect = "https://www.meetup.com/register?returnUri=https%3A%2F%2Fwww.meetup.com%2Fgrp%2Fevents%2F123%2F%3FrecId%3Da%26x%3D1"
    invalid = [("All Events", "https://x.org/a"), ("T", "https://www.meetup.com/pro/x"), ("T", "https://x.org/events/"), ("T", "https://x.org/search-results")]
    fine = [("T", "https://www.meetup.com/g/events/12"), ("T", "https://x.org/research")]
    check(spark, {
        "redirect": (U.clean_url(lit(redirect)), "https://www.meetup.com/grp/events/123/?recId=a"), "fragment": (U.clean_url(lit(" https://a.org/x#y ")), "https://a.org/x"), "normal": (U.normalize_url(lit("https://a.org/x/?q=1#f")), "https://a.org/x"),
        **{f"invalid {t} {u}": (U.is_invalid_link(lit(t), lit(u)), True) for t, u in invalid}, **{f"fine {u}": (U.is_invalid_link(lit(t), lit(u)), False) for t, u in fine},
        **{f"trust {u}": (U.trust_of_url(lit(u)), n) for u, n in {"https://www.owasp.org/x": 30, "https://chapter.owasp.org": 30, "https://notowasp.org": 5, "https://owasp.org:443/": 5}.items()},
        "empty trust": (U.trust(lit(""), L.LEX_TRUST, empty=0), 0), "percent": (T.percent(lit("a b*~/")), "a%20b%2A~%2F"), "null": (U.clean_url(lit(None).cast("string")), ""),
    })
    assert spark.range(1).select(U.resolved(lit("https://a.org/x/y"), lit("../z"))).first()[0] == "https://a.org/z"


def test_text_scores_messages(spark):
    where = [lit(x) for x in ("Offline", "Hall A", "Hall A, 1 Road, Pune", "Pune", "", "India")]
    flags = lambda *on: {k: lit(k not in ("structured", "has_registration", "has_location") or k in on) for k in S.WEIGHTS}
    check(spark, {
        "short": (T.shorten(lit("abcdef"), 5), "ab..."), "nbsp": (T.squeeze(lit("\xa0a\xa0 b\n")), "a b"), "null word": (T.meaningful(lit(" N/A ")), ""), "plain": (T.escape_html(lit("<'\">&")), "&lt;&#x27;&quot;&gt;&amp;"),
        "mode": (M.mode_name(lit("In Person")), "Offline"), "no mode": (M.mode_name(lit("")), "Not specified"), "other mode": (M.mode_name(lit("metaverse")), "Metaverse"), "place": (M.place_text(*where), "Hall A, Pune, India"),
        "confidence": (S.confidence(lit("Cybersecurity Meetup Hyderabad"), lit("Register now. Venue TBA"), lit("Hyderabad"), lit("https://owasp.org/x")), 79),
        **{f"score {on}": (S.verification_score(lit(""), flags(*on)), n) for on, n in {(): 75, ("has_location",): 80, ("has_registration", "has_location"): 85, ("structured",): 95, ("structured", "has_location"): 100}.items()},
        "rejected": (S.verification_score(lit("no"), flags()), 0), "found": (L.found(lit("SOC and CTF"), ["soc", "ctf", "x"]), ["ctf", "soc"]),
    })
    text = spark.range(1).select(M.message({"title": lit("A & B"), "event_mode": lit("offline"), "event_venue": lit("Hall"), "event_date": lit("05 March 2026")})).first()[0]
    assert "📌 <b>A &amp; B</b>" in text and "🏢 <b>Venue:</b> Hall" in text and "query=Hall" in text and text.endswith("🇮🇳 <b>India physical event</b>")
    assert spark.range(1).select(T.plain(lit("<b>R&amp;D</b>"))).first()[0] == "R&D"


def test_html_and_jsonld(spark):
    assert [o["@type"] for o in H.flatten({"@graph": [{"@type": "WebPage"}, {"@type": "Event"}]} | {}) if "@type" in o] == ["WebPage", "Event", "WebPage", "Event"]
    html = '<html><title>T</title><script>x</script><div><p>Intro <a href="/r">Register <b>now</b></a><p>two</div><script type="application/ld+json">{"@type":"Event","location":[{"name":"Hall","address":"1 Road"}]}</script><script type="application/ld+json">{bad</script>'
    page = H.parse(html)
    assert page["title"] == "T" and page["text"] == "T Intro Register now two" and page["links"][0]["text"] == "Register now" and "Intro" in page["links"][0]["context"]
    row = spark.createDataFrame([(html,), (None,)], "html string").select(H.parse_html("html").alias("p")).select(H.event_object("p.objects").alias("e")).select("e", H.structured_place(F.col("e")).alias("w")).collect()
    assert row[0].w.text == "Hall, 1 Road" and row[1].e is None
    types = spark.range(1).select(*[H.is_event_object(lit(j)) for j in ('{"@type":["Thing","MusicEvent"]}', '{"@type":"Eventful"}', "{}")]).first()
    assert list(types) == [True, False, False]


@pytest.mark.parametrize("url", ["https://a.org/x#y", "  https://www.meetup.com/register?returnUri=x ", "", "not a url"])
def test_clean_url_twice_is_once(spark, url):
    once = U.clean_url(lit(url))
    a, b = spark.range(1).select(once, U.clean_url(once)).first()
    assert a == b
