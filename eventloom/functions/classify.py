"""Places, kinds, modes, prices and organisers read from text, and the topical predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .dates import all_dates
from .text import let, meaningful, normal, present, squeeze, text_of

#: Patterns of places, organisers, prices, registration.
PLACE = (
    r"(?i)(?:location|venue|where)\s*[:\-]\s*[^|.\n]{3,160}",
    r"(?i)(?:held at|taking place at)\s+[^|.\n]{3,160}",
    r"(?i)at\s+[A-Z][^|.\n]{3,120},\s*(?:Hyderabad|Bengaluru|Bangalore|Chennai|Mumbai|Pune|Delhi|Noida|Gurgaon|Gurugram|Kolkata|Ahmedabad|Jaipur)",
)
ORGANIZER = (r"(?i)organizer\s*[:\-]\s*([^|.\n]{2,100})", r"(?i)organised by\s+([^|.\n]{2,100})", r"(?i)organized by\s+([^|.\n]{2,100})", r"(?i)hosted by\s+([^|.\n]{2,100})")
PRICE = (r"(?i)(?:₹|INR|Rs\.?|USD|\$|EUR|€|GBP|£)\s*[\d,]+(?:\.\d{1,2})?", r"(?i)[\d,]+(?:\.\d{1,2})?\s*(?:INR|USD|EUR|GBP)")
FREE = r"(?i)\bfree(?: registration| event)?\b"
REGISTERS = r"(?i)\b(register|registration|rsvp|tickets|sign up|reserve|join event)\b"
FOREIGN = f"{L.branched(L.OTHER_COUNTRIES)}(?![a-z])"
EVENT_HINT = r"(?i)\b(register|registration|rsvp|tickets|event date|starts?)\b"


def _low(c: Column) -> Column:
    return F.lower(text_of(c))


# Predicates on link rows and feed items.
def has_india_signal(text: Column) -> Column:
    return L.has_word(normal(text), ["india", *L.COLLECT_CITIES, *L.COLLECT_STATES])


def has_foreign_signal(text: Column) -> Column:
    return L.has_word(normal(text), [*L.FOREIGN_COUNTRIES, *L.FOREIGN_CITIES])


def india_relevance(title: Column, context: Column, url: Column) -> Column:
    """An India signal decides alone: a foreign one without it is no signal either."""
    return has_india_signal(F.concat_ws(" ", text_of(title), text_of(context), text_of(url)))


def is_topical_link(title: Column, context: Column) -> Column:
    both = F.concat_ws(" ", normal(title), normal(context))
    return L.contains_any(both, L.COLLECT_TOPICS) & L.contains_any(both, L.COLLECT_TYPES)


def feed_topic(title: Column, snippet: Column) -> Column:
    return L.contains_any(F.concat_ws(" ", text_of(title), text_of(snippet)), L.LEX_TOPICS)


def feed_event(title: Column, snippet: Column) -> Column:
    return L.contains_any(F.concat_ws(" ", text_of(title), text_of(snippet)), L.RSS_EVENT_WORDS)


def is_possible_event(title: Column, snippet: Column) -> Column:
    return feed_topic(title, snippet) & feed_event(title, snippet)


def is_supported_place(text: Column) -> Column:
    return L.contains_any(text, [*L.LEX_CITIES, *L.LEX_ALIASES, *L.LEX_STATES, *L.LEX_ONLINE, "india"])


# Places.
def city_collect(text: Column) -> Column:
    renamed = {"Bangalore": "Bengaluru", "Mysore": "Mysuru"}
    places = [(c.lower(), renamed.get(c, c)) for c in L.COLLECT_CITIES] + [(s.lower(), s) for s in L.COLLECT_STATES]
    return F.coalesce(L.first_word(normal(text), [*places, ("india", "India"), ("online", "Online"), ("virtual", "Online")]), F.lit("Unknown"))


def city_rss(text: Column) -> Column:
    t = _low(text)
    return F.coalesce(L.first_within(t, [*L.RSS_ALIASES.items(), *((c.lower(), c) for c in L.PLACES), *((w, "Online") for w in L.LEX_ONLINE), ("india", "India")]), F.lit("Unknown"))


def city_lex(text: Column) -> Column:
    t = _low(text)
    own = {c.lower(): c for c in L.LEX_CITIES}
    pairs = [(a, L.LEX_ALIASES[a]) for a in L.longest_first(L.LEX_ALIASES)] + [(c, L.LEX_ALIASES.get(c, own[c])) for c in L.longest_first(own)]
    return F.coalesce(L.first_within(t, pairs), F.lit(""))


def normalize_city(city: Column) -> Column:
    c = squeeze(city)
    table = F.create_map(*[F.lit(x) for p in L.LEX_ALIASES.items() for x in p])
    return F.coalesce(F.try_element_at(table, F.lower(c)), c)


def state_of_city(city: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in L.CITY_STATES.items() for x in p])
    return F.coalesce(F.try_element_at(table, normalize_city(city)), F.lit(""))


def state_lex(text: Column) -> Column:
    own = {s.lower(): s for s in L.LEX_STATES}
    return F.coalesce(L.first_within(_low(text), [(s, own[s]) for s in L.longest_first(own)]), state_of_city(city_lex(text)))


def place_in_text(text: Column) -> Column:
    """The first labelled place, label kept; empty if none or over 180 characters."""
    hits = F.array(*[squeeze(F.regexp_extract(text_of(text), p, 0)) for p in PLACE])
    return F.coalesce(F.get(F.filter(hits, lambda h: (h != "") & (F.length(h) <= 180)), F.lit(0)), F.lit(""))


def city_of_place(place: Column) -> Column:
    return let(_low(place), lambda p: F.coalesce(L.first_within(p, [(c, c.title()) for c in L.longest_first(L.INDIA_CITIES)]), F.lit("")))


def foreign_place(text: Column) -> Column:
    """The longest country name that letters do not touch; empty if none."""
    longest = lambda t: F.coalesce(*[F.when(t.rlike(f"(?<![a-z])(?:{L.folded([c])})(?![a-z])"), F.lit(c)) for c in L.longest_first(L.OTHER_COUNTRIES)], F.lit(""))
    return let(_low(text), lambda t: F.when(t.rlike(f"(?<![a-z]){FOREIGN}"), longest(t)).otherwise(""))


def mode_of(text: Column, place: Column) -> Column:
    both = F.concat_ws(" ", text_of(text), text_of(place))
    return F.when(L.contains_any(both, L.HYBRID_WORDS), "Hybrid").when(L.contains_any(both, L.ONLINE_WORDS), "Online").otherwise("Offline")


def is_in_india(place: Column, page: Column, mode: Column) -> Column:
    abroad = lambda t: _low(t).rlike(f"(?<![a-z]){FOREIGN}")
    physical = mode.isin("Offline", "Hybrid") & L.contains_any(place, L.INDIA_TERMS)
    online = (mode == "Online") & ~abroad(page) & L.contains_any(page, L.INDIA_TERMS)
    return ~abroad(place) & (physical | online)


# Kinds, prices, organisers.
def type_of_page(structured: Column, text: Column) -> Column:
    given = meaningful(structured)
    t = _low(text)
    return F.when((given != "") & (F.lower(given) != "event"), given).otherwise(F.coalesce(L.first_within(t, [(w, w.title()) for w in L.PAGE_TYPES]), F.lit("Event")))


def type_lex(text: Column) -> Column:
    return F.coalesce(L.first_within(_low(text), [(w, w) for w in L.longest_first(L.LEX_TYPES)]), F.lit(""))


def price_of_page(price: Column, currency: Column, text: Column) -> Column:
    """Offered price, else the first hit of a currency pattern that holds a digit, else Free, else Not specified."""
    t = text_of(text)
    offered = let(meaningful(price), lambda p: F.when(p.rlike(r"\d"), F.trim(F.concat_ws(" ", meaningful(currency), p))).otherwise(""))
    hits = F.array(offered, *[squeeze(F.regexp_extract(t, x, 0)) for x in PRICE])
    return F.coalesce(F.get(F.filter(hits, lambda h: h.rlike(r"\d")), F.lit(0)), F.when(t.rlike(FREE), "Free"), F.lit("Not specified"))


def sane_price(price: Column) -> Column:
    """A currency without an amount says nothing."""
    return F.when(F.lower(F.trim(price)).isin(L.BARE_CURRENCIES), "Not specified").otherwise(price)


def price_lex(text: Column) -> Column:
    return F.when(L.contains_any(text, L.LEX_FREE), "Free").when(L.contains_any(text, L.LEX_PAID), "Paid / Check event page").otherwise("")


def organizer_of(structured: Column, text: Column) -> Column:
    hits = F.array(meaningful(structured), *[squeeze(F.regexp_extract(text_of(text), p, 1)) for p in ORGANIZER])
    return F.coalesce(F.get(F.filter(hits, lambda h: h != ""), F.lit(0)), F.lit(""))


# Page predicates.
def is_strong_topic(title: Column, description: Column) -> Column:
    return L.contains_any(F.concat_ws(" ", text_of(title), text_of(description)), L.STRONG_TOPICS)


def is_event(title: Column, description: Column, text: Column) -> Column:
    return L.contains_any(F.concat_ws(" ", text_of(title), text_of(description)), L.EVENT_WORDS) | text_of(text).rlike(EVENT_HINT)


def registers(registration_url: Column, text: Column) -> Column:
    return (text_of(registration_url) != "") | text_of(text).rlike(REGISTERS)


def is_listing(title: Column, text: Column, structured: Column, structured_name: Column, structured_start: Column, dates: Column | None = None) -> Column:
    """A page of many events: by its title, by eight dates, or, with a structured event, by its phrases or its name.
    ``dates`` are those of the text, if they are known already."""
    phrases = F.size(L.found(text, L.LISTING_PHRASES)) >= 3
    generic = F.lower(meaningful(structured_name)).isin(L.GENERIC_NAMES) & (meaningful(structured_start) == "")
    return L.contains_any(title, L.LISTING_PHRASES) | (F.size(all_dates(text) if dates is None else dates) >= 8) | (structured & (phrases | generic))


def is_listing_reason(reason: Column) -> Column:
    """Whether a rejection says that the page lists many events."""
    return _low(reason).rlike("listing|index|category")


def title_of_page(title: Column, text: Column) -> Column:
    """The page title unless it only names the platform; then what the text calls the event."""
    hits = [squeeze(F.regexp_extract(text_of(text), p, 1)) for p in (r"(?i)(?:event|title)\s*[:\-]\s*([^|]{5,180})", r"(?i)join\s+(.{5,160})")]
    bare = lambda t: (t == "") | F.lower(t).isin("meetup", "luma", "eventbrite", "events", "event", "sign in", "log in")
    return let(meaningful(title), lambda t: F.when(~bare(t), t).otherwise(F.coalesce(F.get(F.filter(F.array(*hits), lambda h: h != ""), F.lit(0)), t)))


def description_of(structured: Column, meta: Column, og: Column, text: Column) -> Column:
    return F.left(present(meaningful(structured), meaningful(meta), meaningful(og), text_of(text)), F.lit(1000))
