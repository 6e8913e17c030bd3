"""Candidates to verified events: one left join to pages, one parse, then columns in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import classify as C
from eventloom.functions import dates as D
from eventloom.functions import html as H
from eventloom.functions import scoring as S
from eventloom.functions.text import meaningful, present, text_of

STORED_TEXT = 20_000
FEW = 200_000  # urls that are sent to every task of the pages' scan


def _title(e: Column) -> Column:
    return C.title_of_page(present(meaningful(F.get_json_object(e, "$.name")), F.col("title")), F.col("text"))


def _description(e: Column) -> Column:
    return C.description_of(F.get_json_object(e, "$.description"), F.col("description"), F.col("og_description"), F.col("text"))


def _start(e: Column) -> Column:
    return D.date_text(H.at(e, "$.startDate", "$.startTime", "$.start"))


def _end(e: Column) -> Column:
    return D.date_text(H.at(e, "$.endDate", "$.endTime", "$.end"))


def _listing(e: Column) -> Column:
    return C.is_listing(F.col("title"), F.col("text"), F.col("structured"), F.get_json_object(e, "$.name"), H.at(e, "$.startDate", "$.startTime"), F.col("page_dates"))


def signals(rows: DataFrame, as_of: Column) -> DataFrame:
    """Add the verification columns to rows of reachable, title, text, description, og_description, event (JSON text or
    null) and registration_url."""
    e = F.col("event")
    dated = rows.withColumn("page_dates", D.all_dates(F.col("text")))
    fields = dated.withColumns({
        "place": H.structured_place(e), "structured": e.isNotNull(), "title": _title(e), "page_description": _description(e), "start": _start(e), "end": _end(e),
        "primary": D.primary_date(F.col("text"), F.col("page_dates")), "text_place": C.place_in_text(F.col("text")),
    })
    own = F.col("place.text") != ""
    fields = fields.withColumns({
        "event_date": F.when(F.col("start") != "", F.col("start")).otherwise(F.col("primary")), "event_end_date": F.col("end"),
        "date_source": F.when(F.col("start") != "", "Schema.org").when(F.col("primary") != "", "Page text").otherwise(""),
        "event_location": F.when(own, F.col("place.text")).otherwise(F.col("text_place")), "event_venue": F.col("place.venue"),
        "event_city": F.when(own, F.col("place.city")).otherwise(C.city_of_place(F.col("text_place"))), "event_state": F.when(own, F.col("place.state")).otherwise(""), "event_country": F.col("place.country"),
        "location_source": F.when(own, "Schema.org").when(F.col("text_place") != "", "Page text").otherwise(""),
    }).withColumns({
        "detected_dates": D.detected_dates(F.col("event_date"), F.col("event_end_date"), F.col("page_dates")),
        "event_mode": C.mode_of(F.col("text"), F.col("event_location")), "event_time": D.clock(H.at(e, "$.startDate", "$.startTime"), F.col("text")),
        "event_organizer": C.organizer_of(H.at(e, "$.organizer.name", "$.organizer.legalName", "$.organizer[0].name"), F.col("text")),
        "event_type": C.type_of_page(H.at(e, "$.eventType", "$.type"), F.col("text")),
        "event_price": C.price_of_page(H.at(e, "$.offers[0].price", "$.offers[0].lowPrice", "$.offers.price", "$.offers.lowPrice"), H.at(e, "$.offers[0].priceCurrency", "$.offers.priceCurrency", "$.offers.currency"), F.col("text")),
        "listing": _listing(e),
        "has_topic": C.is_strong_topic(F.col("title"), F.col("page_description")), "has_event": C.is_event(F.col("title"), F.col("page_description"), F.col("text")), "has_registration": C.registers(F.col("registration_url"), F.col("text")),
    })
    # A listing page loses its dates before they are validated.
    reset = fields.withColumns({c: F.when(F.col("listing"), "").otherwise(F.col(c)) for c in ("event_date", "event_end_date")} | {"detected_dates": F.when(F.col("listing"), F.array().cast("array<string>")).otherwise(F.col("detected_dates"))})
    checked = reset.withColumns({
        "has_date": F.col("event_date") != "", "has_future_date": D.is_upcoming(F.col("event_date"), as_of), "has_location": F.col("event_location") != "",
        "has_india": C.is_in_india(F.col("event_location"), F.col("text"), F.col("event_mode")), "foreign": C.foreign_place(F.col("event_location")),
        "is_topical": F.col("has_topic"), "is_event_page": ~F.col("listing") & F.col("has_event") & (F.col("structured") | (F.col("event_date") != "")), "is_online": F.col("event_mode") == "Online",
    })
    reason = S.rejection(*[F.col(c) for c in ("listing", "has_topic", "has_event", "has_date", "has_future_date", "event_mode", "has_india", "foreign")])
    scored = checked.withColumn("rejected_reason", F.when(~F.col("reachable"), "Page could not be reached").otherwise(reason))
    return scored.withColumns({
        "event_end_date": D.sane_end(F.col("event_date"), F.col("event_end_date")),
        "event_price": C.sane_price(F.col("event_price")),
        "score": S.verification_score(F.col("rejected_reason"), {k: F.col(k) for k in S.WEIGHTS}),
    })


def decide(rows: DataFrame, as_of: Column) -> DataFrame:
    """Add ``gate`` to rows as ``signals`` takes them: the gate that stops the row once its signals are known, or accepted.

    What only describes an event is left to ``signals``, and a detector reads only rows that those before it left: a
    rejected row scores nothing whatever else its page says. Title, description and start come first, then the dates, then
    the place."""
    e, none = F.col("event"), F.lit("")
    named = rows.withColumns({"raw_title": F.col("title"), "structured": e.isNotNull(), "title": _title(e), "page_description": _description(e)})
    topical = named.withColumn("open", F.col("reachable") & C.is_strong_topic(F.col("title"), F.col("page_description")) & C.is_event(F.col("title"), F.col("page_description"), F.col("text")))
    dated = topical.withColumns({"page_dates": F.when(F.col("open"), D.all_dates(F.col("text"))), "start": F.when(F.col("open"), _start(e))})
    dated = dated.withColumn("event_date", F.when(F.col("open"), F.when(F.col("start") != "", F.col("start")).otherwise(D.primary_date(F.col("text"), F.col("page_dates")))))
    coming = dated.withColumn("open", F.coalesce(F.col("open") & (F.col("event_date") != "") & D.is_upcoming(F.col("event_date"), as_of) & ~_listing(e), F.lit(False)))
    placed = coming.withColumn("place", F.when(F.col("open"), H.structured_place(e)["text"]))
    placed = placed.withColumn("place", F.when(F.col("open"), F.when(F.col("place") != "", F.col("place")).otherwise(C.place_in_text(F.col("text")))))
    placed = placed.withColumn("event_mode", F.when(F.col("open"), C.mode_of(F.col("text"), F.col("place"))))
    placed = placed.withColumn("has_india", F.when(F.col("open"), C.is_in_india(F.col("place"), F.col("text"), F.col("event_mode"))))
    yes, no = F.lit(True), F.lit(False)
    reason = F.when(F.col("open"), S.rejection(no, yes, yes, yes, yes, F.col("event_mode"), F.col("has_india"), none)).otherwise("rejected before")
    left = placed.withColumn("open", reason == "")
    flags = {k: yes for k in S.WEIGHTS} | {"structured": F.col("structured"), "has_location": F.col("place") != "", "has_india": F.col("has_india"), "has_registration": C.registers(F.col("registration_url"), F.col("text"))}
    scored = left.withColumns({"score": F.when(F.col("open"), S.verification_score(none, flags)).otherwise(0), "detected_dates": F.when(F.col("open"), D.detected_dates(F.col("event_date"), _end(e), F.col("page_dates")))})
    gated = scored.withColumn("is_today", F.when(F.col("open"), D.covers(F.col("detected_dates"), as_of))).withColumn("gate", gate())
    return gated.select(*[F.col("raw_title").alias("title") if c == "title" else F.col(c) for c in rows.columns], "gate")


def verify(candidates: DataFrame, pages: DataFrame, as_of: Column, few: int = FEW) -> DataFrame:
    """All signals of ``read_pages``; the text column that is kept ends after ``STORED_TEXT`` characters."""
    return signals(read_pages(candidates, pages, few), as_of).withColumn("text", F.left("text", F.lit(STORED_TEXT)))


def read_pages(candidates: DataFrame, pages: DataFrame, few: int = FEW) -> DataFrame:
    """Candidates (url, ...) left joined to pages (url, html; one row a url); a page that is missing is not reachable.

    Pages are picked and parsed where they are: the candidates' urls go to them, by broadcast once they are counted to be
    ``few`` at most, and only what was read of a page moves. Every detector reads the whole text."""
    from eventloom.functions.urls import first_resolved

    final = F.col("final_url") if "final_url" in pages.columns else F.col("url")
    missing = [F.lit("").alias(c) for c in ("title", "description", "source") if c not in candidates.columns]
    known = candidates.select("*", *missing).withColumnsRenamed({"title": "candidate_title", "description": "candidate_description"})
    urls = known.select("url").where(F.col("url").isNotNull()).distinct()
    urls = F.broadcast(urls) if urls.limit(few + 1).count() <= few else urls
    asked = pages.select("url", final.alias("final_url"), "html").where(F.col("html").isNotNull()).join(urls, "url", "left_semi")
    labelled = F.transform(F.filter("page.links", lambda x: F.lower(x["text"]).rlike("|".join(C.L.REGISTER_LABELS))), lambda x: x["href"])
    read = asked.withColumn("page", H.parse_html("html")).select(
        "url", "final_url", F.lit(True).alias("read"), F.col("page.title").alias("page_title"), F.col("page.og_title").alias("og_title"), F.col("page.text").alias("text"), F.col("page.description").alias("description"),
        F.col("page.og_description").alias("og_description"), F.get("page.objects", F.lit(0)).alias("event"), first_resolved(F.coalesce("final_url", "url"), labelled).alias("registration_url"),
    )
    rows = known.join(read, "url", "left").withColumns({
        "reachable": F.col("read").isNotNull(), "title": present(F.col("page_title"), F.col("og_title"), F.col("candidate_title")), "text": text_of(F.col("text")), "registration_url": F.coalesce("registration_url", F.lit("")),
    })
    return rows.drop("read", "page_title", "og_title")


def gate() -> Column:
    """The first gate that stops a verified row: unreachable, low score, no date, not today; else accepted."""
    return F.when(~F.col("reachable"), "unreachable").when(F.col("score") < 40, "low score").when(F.size("detected_dates") == 0, "unknown date").when(~F.col("is_today"), "not today").otherwise("accepted")
