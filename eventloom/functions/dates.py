"""Dates in text. A date leaves as 'dd Month yyyy'; what is not a date leaves as an empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, meaningful, squeeze, strip, text_of

#: Month names, date spellings in the order in which a page is searched, labels before a date.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ISO = r"\b\d{4}-\d{2}-\d{2}\b"
NUMERIC = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
MONTH_DAY_YEAR = rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}},\s*\d{{4}}\b"
DAY_MONTH_YEAR = rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b"
MONTH_DAY = rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}}(?:,\s*\d{{4}})?\b"
PAGE_ORDER = (MONTH_DAY_YEAR, DAY_MONTH_YEAR, MONTH_DAY, NUMERIC, ISO)
LABEL = r"(?i)(?:event\s+date|date|starts?|start(?:s)?\s+on)\s*[:\-]?\s*"
TIMES = (r"(?i)\b\d{1,2}:\d{2}\s*(?:AM|PM)\b", r"(?i)\b\d{1,2}\s*(?:AM|PM)\b", r"\b(?:[01]?\d|2[0-3]):[0-5]\d\b")


def _date(text: Column, pattern: str) -> Column:
    return F.try_to_date(text, pattern)


def _written(d: Column) -> Column:
    return F.date_format(d, "dd MMMM yyyy")


def _numeric(raw: Column) -> Column:
    """Day first, then month first; slashes take two-digit years, which turn the century at 69."""
    part = lambda n: F.regexp_extract(raw, r"^(\d{1,2})([/-])(\d{1,2})([/-])(\d{2,4})$", n)
    a, b, year, same = part(1), part(3), part(5), part(2) == part(4)
    two = F.try_to_number(F.when(F.length(year) == 2, year), F.lit("99")).cast("int")
    full = F.when(F.length(year) == 4, year).when((F.length(year) == 2) & (part(2) == "/"), (F.when(two >= 69, two + 1900).otherwise(two + 2000)).cast("string"))
    made = lambda d, m: F.when(same & full.isNotNull(), _date(F.concat_ws("-", d, m, full), "d-M-yyyy"))
    return F.coalesce(made(a, b), made(b, a))


def parse_date(value: Column) -> Column:
    """The date that a text names: ISO, 'Month d, yyyy', 'd Month yyyy', then numeric; the first hit of each spelling is
    tried. Every capital T parts words, as it does in a timestamp."""
    return let(F.replace(meaningful(value), F.lit("T"), F.lit(" ")), _cascade)


def _cascade(v: Column) -> Column:
    iso = _date(F.nullif(F.regexp_extract(v, ISO, 0), F.lit("")), "yyyy-MM-dd")
    named = rf"(?i)\b({MONTHS})\s+(\d{{1,2}})(?:,\s*(\d{{4}}))?\b"
    month_first = F.when(F.regexp_extract(v, named, 3) != "", _date(F.concat_ws(" ", *[F.regexp_extract(v, named, n) for n in (2, 1, 3)]), "d MMMM yyyy"))
    day = rf"(?i)\b(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})\b"
    day_first = F.when(F.regexp_extract(v, day, 3) != "", _date(F.concat_ws(" ", *[F.regexp_extract(v, day, n) for n in (1, 2, 3)]), "d MMMM yyyy"))
    return F.coalesce(iso, month_first, day_first, let(F.nullif(F.regexp_extract(v, NUMERIC, 0), F.lit("")), _numeric))


def date_text(value: Column) -> Column:
    return F.coalesce(_written(parse_date(value)), F.lit(""))


#: Spellings of a whole-text date, each with the shape that a text needs before it is parsed.
WHOLE = (
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
)


def parse_whole(value: Column) -> Column:
    """A date that is the whole text, in one of ten spellings; numbers are day first."""
    return let(strip(value), _whole)


def _whole(v: Column) -> Column:
    may = F.when(v.rlike(r"(?i)^\d{1,2} may \d{4}$"), _date(v, "d MMM yyyy"))
    return F.coalesce(*[F.when(v.rlike(shape), _date(F.when(v.rlike(shape), v), form)) for shape, form in WHOLE], may)


def all_dates(text: Column) -> Column:
    """Every date of a text, by spelling and then by place, each once. A month and day names no date without a year, and
    with one it was found before, so the text is not searched for it."""
    hits = F.concat(*[F.regexp_extract_all(text_of(text), F.lit(p.replace(r"\b(?:J", r"\b(?=[JFMASOND])(?:J")), F.lit(0)) for p in PAGE_ORDER if p != MONTH_DAY])
    return F.array_distinct(F.filter(F.transform(F.array_distinct(hits), date_text), lambda d: d != ""))


def primary_date(text: Column, dates: Column | None = None) -> Column:
    """A labelled date, or else the first of all_dates; empty if none. ``dates`` are the latter, if they are known already."""
    t = text_of(text)
    labelled = [_written(parse_date(F.regexp_extract(t, LABEL + f"({p})", 1))) for p in (rf"(?:{MONTHS})\s+\d{{1,2}}(?:,\s*\d{{4}})?", rf"\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}")]
    return F.coalesce(*labelled, F.get(all_dates(t) if dates is None else dates, F.lit(0)), F.lit(""))


def detected_dates(start: Column, end: Column, page: Column) -> Column:
    """Start, and end if it differs; without either the first five dates of the page."""
    given = F.array_distinct(F.filter(F.array(start, end), lambda d: d != ""))
    return F.when(F.size(given) > 0, given).otherwise(F.slice(page, 1, 5))


def sane_end(start: Column, end: Column) -> Column:
    """The end date, unless it is before the start or over 31 days later."""
    days = F.datediff(_date(end, "dd MMMM yyyy"), _date(start, "dd MMMM yyyy"))
    return F.when((start == "") | (end == "") | days.between(0, 31), end).otherwise("")


def is_upcoming(text: Column, as_of: Column) -> Column:
    return F.coalesce(parse_date(text) >= as_of, F.lit(False))


def is_day(text: Column, day: Column) -> Column:
    """Whether the text's date is that day."""
    return F.coalesce(parse_date(text) == day, F.lit(False))


def covers(dates: Column, today: Column) -> Column:
    """Whether any of the dates is today, or today lies between the least and the greatest."""
    ds = F.filter(F.transform(dates, parse_whole), lambda d: d.isNotNull())
    return F.coalesce(F.array_contains(ds, today) | today.between(F.array_min(ds), F.array_max(ds)), F.lit(False))


def today_in(zone: str) -> Column:
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(zone), F.current_timestamp().cast("timestamp_ntz")))


def clock(structured_start: Column, text: Column) -> Column:
    given = F.regexp_extract(meaningful(structured_start), r"T(\d{2}:\d{2})(?::\d{2})?", 1)
    hits = F.array(given, *[squeeze(F.regexp_extract(text_of(text), p, 0)) for p in TIMES])
    return F.coalesce(F.get(F.filter(hits, lambda x: x != ""), F.lit(0)), F.lit(""))


def date_range(start: Column, end: Column) -> Column:
    return F.when(start.isin("", "Not specified"), "Not specified").when(end.isin("", "Not specified") | (end == start), start).otherwise(F.concat(start, F.lit(" – "), end))
