"""Message text of an event, from its columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import date_range
from .text import escape_html, percent, shorten, stated, strip
from .urls import first_web

MESSAGE_LIMIT, DESCRIPTION_LIMIT = 3900, 800
UNKNOWN = "Not specified"
MAPS = "https://www.google.com/maps/search/?api=1&query="


def mode_name(mode: Column) -> Column:
    m = F.lower(strip(mode))
    return F.when(m.isin("online", "virtual", "remote"), "Online").when(m.isin("offline", "in-person", "in person", "physical"), "Offline").when(m == "", UNKNOWN).otherwise(F.initcap(m))


def is_online(mode: Column, place: Column) -> Column:
    return mode_name(mode).isin("Online", "Hybrid") | F.lower(place).rlike("online|virtual|remote")


def _distinct_parts(*parts: Column) -> Column:
    """Known parts in order, each once whatever its case."""
    known = F.filter(F.array(*parts), lambda p: ~p.isin("", UNKNOWN))
    none = F.array().cast("array<string>")
    return F.aggregate(known, none, lambda acc, p: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p))))


def maps_link(mode: Column, venue: Column, place: Column, city: Column, state: Column, country: Column) -> Column:
    parts = _distinct_parts(venue, place, city, state, country)
    return F.when(is_online(mode, place) | (F.size(parts) == 0), "").otherwise(F.concat(F.lit(MAPS), percent(F.array_join(parts, ", "), True)))


def place_text(mode: Column, venue: Column, place: Column, city: Column, state: Column, country: Column) -> Column:
    """Constant for online events; for physical ones the venue, the place unless it names the venue, then the rest."""
    within = (venue != "") & F.contains(F.lower(place), F.lower(venue))
    parts = F.array_join(_distinct_parts(venue, F.when(within, "").otherwise(place), city, state, country), ", ")
    name = mode_name(mode)
    return F.when(name == "Online", "Online / Virtual").when(name == "Hybrid", F.when(place == "", "Hybrid").otherwise(place)).when(parts == "", UNKNOWN).otherwise(parts)


def description_text(event_description: Column, description: Column) -> Column:
    known = [F.when(~stated(c, "").isin("", UNKNOWN), stated(c, "")) for c in (event_description, description)]
    return F.coalesce(*known, F.lit("No description available."))


def origin_label(mode: Column, country: Column) -> Column:
    name, home = mode_name(mode), F.lower(country) == "india"
    return (
        F.when((name == "Online") & home, "🌐 <b>Online event — India</b>").when(name == "Online", "🌍 <b>International online event</b>")
        .when((name == "Hybrid") & home, "🇮🇳 <b>India hybrid event</b>").when(name == "Hybrid", "🌐 <b>Hybrid cybersecurity event</b>").otherwise("🇮🇳 <b>India physical event</b>")
    )


def message(e: dict[str, Column]) -> Column:
    """The whole message; values are escaped, the description is cut before that and the message after it."""
    get = lambda k, d="": stated(e.get(k, F.lit(None)), d)
    mode, venue, place = get("event_mode"), get("event_venue"), get("event_location")
    where = (mode, venue, place, get("event_city"), get("event_state"), get("event_country"))
    safe = lambda c: escape_html(c)
    line = lambda label, c: F.concat(F.lit(label), safe(c))
    link = lambda icon, url, label: F.concat(F.lit(f'{icon} <b><a href="'), safe(url), F.lit(f'">{label}</a></b>'))
    registration = first_web(e.get("registration_url", F.lit(None)), e.get("register_url", F.lit(None)), e.get("registration_link", F.lit(None)))
    page = first_web(e.get("event_url", F.lit(None)), e.get("url", F.lit(None)), e.get("link", F.lit(None)))
    maps = maps_link(*where)
    blank = F.lit("")
    lines = F.array(
        F.lit("🔐 <b>CYBERSECURITY EVENT</b>"), F.lit("━" * 20), blank,
        F.concat(F.lit("📌 <b>"), safe(get("title", "Cybersecurity Event")), F.lit("</b>")), blank,
        line("📅 <b>Date:</b> ", date_range(get("event_date"), get("event_end_date"))), line("🕐 <b>Time:</b> ", get("event_time", UNKNOWN)),
        line("📍 <b>Location:</b> ", place_text(*where)), line("🌐 <b>Mode:</b> ", mode_name(mode)),
        F.when(~venue.isin("", UNKNOWN) & (mode_name(mode) != "Online"), line("🏢 <b>Venue:</b> ", venue)),
        line("🏛️ <b>Organizer:</b> ", get("event_organizer", UNKNOWN)), line("🎯 <b>Type:</b> ", get("event_type", UNKNOWN)), line("💰 <b>Price:</b> ", get("event_price", UNKNOWN)), blank,
        F.lit("📝 <b>Description:</b>"), safe(shorten(description_text(e.get("event_description", F.lit(None)), e.get("description", F.lit(None))), DESCRIPTION_LIMIT)), blank,
        F.when(registration != "", link("🎟️", registration, "Register / Tickets")).otherwise("🎟️ <b>Registration:</b> Not found"),
        F.when(page != "", link("🔗", page, "Event Page")), F.when(maps != "", link("🗺️", maps, "Google Maps")), blank,
        F.concat(F.lit("🔎 <b>Verification:</b> "), safe(F.coalesce(e.get("verification_score", F.lit(None)).cast("string"), F.lit("0"))), F.lit("/100")),
        line("🌐 <b>Source:</b> ", get("source", "Unknown")), blank, origin_label(mode, where[5]),
    )
    return shorten(F.array_join(F.array_compact(lines), "\n"), MESSAGE_LIMIT)
