"""URL functions, on the text of a URL; malformed ones never raise."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import let
from .lexicon import INVALID_TITLES, RSS_TRUST
from .text import meaningful, normal, percent, strip, text_of

#: Parameters that a redirect target keeps, listing paths, reserved calendar paths.
KEPT_PARAMETERS = ("eventorigin", "recId", "recSource")
LISTING_PATHS = r"/events/?$|/event/$|/search|/(?:discover|calendar|categories|archive|directory|chapters|find|groups|topics|messages|members|about)/?$"
RESERVED = ("", "/discover", "/search", "/signin", "/login", "/create", "/calendar")


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def parameter(url: Column, name: str) -> Column:
    """Decoded first value of a query parameter; empty if it has none."""
    raw = F.regexp_extract(text_of(url), rf"^[^?#]*\?(?:[^#]*?&)?{re.escape(name)}=([^&#]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def clean_url(url: Column) -> Column:
    """Stripped, without fragment; a registration redirect of the meetup host becomes the event page that it returns to,
    with the few parameters that matter."""
    return let(strip(F.regexp_replace(strip(url), r"#.*$", "")), lambda bare: let(parameter(bare, "returnUri"), lambda target: _returned(bare, target)))


def _returned(bare: Column, target: Column) -> Column:
    """Both are variables: written out at each place that names them, an address would plan for minutes."""
    redirect = F.contains(authority(bare), F.lit("meetup.com")) & (F.lower(F.regexp_replace(path(bare), r"/+$", "")) == "/register")
    target = parameter(bare, "returnUri")
    kept = F.array_compact(F.array(*[F.when(target.rlike(rf"[?&]{p}="), F.concat(F.lit(f"{p}="), F.replace(percent(parameter(target, p)), F.lit("%20"), F.lit("+")))) for p in KEPT_PARAMETERS]))
    page = F.concat(F.lit("https://www.meetup.com"), path(target), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    usable = F.contains(authority(target), F.lit("meetup.com")) & F.contains(F.lower(path(target)), F.lit("/events/"))
    return F.when(redirect & usable, page).otherwise(bare)


def cut_fragment(url: Column) -> Column:
    return F.substring_index(meaningful(url), "#", 1)


def normalize_url(url: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(strip(url), r"[?#].*$", ""), r"/+$", "")


def domain(url: Column) -> Column:
    """Lower-case authority without a leading www., port kept."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def platform(url: Column) -> Column:
    host = authority(url)
    return F.when(F.contains(host, F.lit("meetup.com")), "Meetup").when(F.contains(host, F.lit("lu.ma")), "Luma").when(F.contains(host, F.lit("eventbrite.")), "Eventbrite").otherwise("Other")


def platform_of_page(url: Column, text: Column) -> Column:
    both = F.lower(F.concat_ws(" ", text_of(url), text_of(text)))
    out = F.lit("")
    for marker, name in reversed((("meetup.com", "Meetup"), ("lu.ma", "Luma"), ("eventbrite", "Eventbrite"), ("owasp.org", "OWASP"), ("bsides", "BSides"))):
        out = F.when(F.contains(both, F.lit(marker)), name).otherwise(out)
    return out


def is_real_event_url(url: Column) -> Column:
    host, where = authority(url), F.lower(path(url))
    return (
        F.when(F.contains(host, F.lit("meetup.com")), where.rlike(r"/events/\d+"))
        .when(F.contains(host, F.lit("lu.ma")), ~F.regexp_replace(where, r"/+$", "").isin(*RESERVED))
        .when(F.contains(host, F.lit("eventbrite.")), where.rlike(r"/e/[^/]+"))
        .otherwise(F.lit(True))
    )


def is_invalid_link(title: Column, url: Column) -> Column:
    low = F.lower(clean_url(url))
    return (
        (low == "")
        | (F.contains(authority(low), F.lit("meetup.com")) & ~path(low).rlike(r"/events/\d+"))
        | normal(title).isin(INVALID_TITLES)
        | low.rlike(LISTING_PATHS)
    )


def is_web(url: Column) -> Column:
    return text_of(url).rlike(r"(?i)^https?://")


def _joined(base: str | None, ref: str | None) -> str | None:
    try:
        return urljoin(base or "", (ref or "").strip())
    except ValueError:
        return None


def _resolved(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([_joined(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


def _first_resolved(base: pd.Series, refs: pd.Series) -> pd.Series:
    web = lambda u: (u or "").lower().startswith(("http://", "https://"))
    return pd.Series([next((u for r in (() if rs is None else rs) if web(u := _joined(b, r))), "") for b, rs in zip(base, refs, strict=True)], dtype=object)


def first_resolved(base: Column, refs: Column) -> Column:
    """The first of several references that resolves to a web address; empty if none."""
    return F.pandas_udf(_first_resolved, StringType()).asNondeterministic()(base, refs)


def resolved(base: Column, ref: Column) -> Column:
    """RFC 3986 resolution of a reference; null where it is malformed. Not deterministic to the optimizer, so filters on
    the address stay above it and do not write it out once for each of their terms."""
    return F.pandas_udf(_resolved, StringType()).asNondeterministic()(base, ref)


def trust(host: Column, table: dict[str, int], empty: int = 5, other: int = 5) -> Column:
    """Score of the first listed domain that is the host or a parent of it."""
    out = F.lit(other)
    for name, score in reversed(table.items()):
        out = F.when((host == name) | F.endswith(host, F.lit(f".{name}")), score).otherwise(out)
    return F.when(host == "", empty).otherwise(out).cast("int")


def trust_of_url(url: Column) -> Column:
    return trust(domain(url), RSS_TRUST)


def first_web(*columns: Column) -> Column:
    """The first that begins with http:// or https://, stripped; else empty."""
    return F.coalesce(*[F.when(strip(c).rlike("^https?://"), strip(c)) for c in columns], F.lit(""))
