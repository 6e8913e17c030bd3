"""The one Python boundary: a page's HTML parsed once into title, visible text, meta tags, links and JSON-LD events."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonld import first_event, walk
from .text import let, meaningful, present

UNSEEN = ("script", "style", "noscript", "svg", "template")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
SCHEMA = "title string, text string, description string, og_description string, og_title string, links array<struct<text:string,href:string,context:string>>, objects array<string>"

# An ampersand that begins no closed reference; what scripts and styles hold is never decoded.
UNCLOSED = re.compile(r"(?is)(<(script|style)\b.*?</\2)|&(?!(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);)")
NAMES = ["title", "text", "description", "og_description", "og_title", "links", "objects"]


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] | None = None
        self.meta: dict[str, str] = {}
        self.links: list[dict] = []
        self.scripts: list[str] = []
        self.stack: list[tuple[str, int, int]] = []  # element, first text part, open link
        self.open: dict[str, int] = {}  # elements of the stack by name
        self.inside: list[int] = []  # open links
        self.waiting: dict[int, list[tuple[dict, int]]] = {}  # links by the depth of the containers that hold them
        self.unseen = 0
        self.ld: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault(a.get("name") or a.get("property", ""), a.get("content", ""))
        link = -1
        if tag == "a" and "href" in a:
            link = len(self.links)
            self.links.append({"href": a["href"], "parts": [], "up": [s[1] for s in self.stack[-2:]]})
            for k in range(1, len(self.links[-1]["up"]) + 1):
                self.waiting.setdefault(len(self.stack) - k, []).append((self.links[-1], k))
        if tag in VOID:
            return
        self.stack.append((tag, len(self.parts), link))
        self.open[tag] = self.open.get(tag, 0) + 1
        if link >= 0:
            self.inside.append(link)
        if tag in UNSEEN:
            self.unseen += 1
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.ld = []
        if tag == "title" and self.title is None:
            self.title = []

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while self.stack:
            name, _, link = self.stack.pop()
            self.open[name] -= 1
            if link >= 0:
                self.inside.pop()
            self.unseen -= name in UNSEEN
            for x, k in self.waiting.pop(len(self.stack), ()):
                x[f"c{k}"] = (x["up"][-k], len(self.parts))  # a container ends here: what it holds is the links' context
            if name == "script" and self.ld is not None:
                self.scripts.append("".join(self.ld))
                self.ld = None
            if name == tag:
                break

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        if self.unseen:
            return
        if self.stack and self.stack[-1][0] == "title" and self.title is not None:
            self.title.append(data)
        if s := " ".join(data.split()):
            self.parts.append(s)
            for link in self.inside:
                self.links[link]["parts"].append(s)


def flatten(value) -> list[dict]:
    """Every object in a JSON-LD value: those of a graph before it and again in their place."""
    return list(walk(value)) if isinstance(value, (dict, list)) else []


def parse(html: str | None) -> dict:
    p = _Page()
    p.feed(html or "")
    p.close()
    event = first_event(p.scripts)
    links = []
    held: dict[tuple[int, int], str] = {}  # links of a container share its text
    for x in p.links:
        spans = [x.get(f"c{k}", (0, len(p.parts))) for k in (1, 2)]
        for a, b in spans:
            if (a, b) not in held:
                held[a, b] = " ".join(p.parts[a:b])
        links.append({"text": " ".join(x["parts"]), "href": x["href"], "context": max((held[s] for s in spans), key=len)})
    return {
        "title": " ".join("".join(p.title or []).split()), "text": " ".join(p.parts), "description": p.meta.get("description", ""), "og_description": p.meta.get("og:description", ""),
        "og_title": p.meta.get("og:title", ""), "links": links, "objects": [] if event is None else [event],
    }


def closed_only(html: str | None) -> str:
    """The page with every reference that lacks its semicolon written out as text."""
    return UNCLOSED.sub(lambda m: m[1] or "&amp;", html or "")


def _parsed(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(h) for h in html], columns=NAMES)


def _parsed_closed(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(closed_only(h)) for h in html], columns=NAMES)


def parse_html(html: Column | str, unclosed: bool = True) -> Column:
    """The parsed page. Not deterministic to the optimizer, so a filter on a field of it cannot make it run twice.
    ``unclosed``: references without a semicolon (``&amp</p>``) are decoded, as browsers do; else they stay as written."""
    return F.pandas_udf(_parsed if unclosed else _parsed_closed, SCHEMA).asNondeterministic()(html)


def is_event_object(j: Column) -> Column:
    """Whether an object's @type, or one of them, is an event."""

    def test(kind: Column) -> Column:
        many = F.exists(F.coalesce(F.from_json(kind, "array<string>"), F.array().cast("array<string>")), lambda t: F.endswith(t, F.lit("event")))
        return F.when(F.startswith(kind, F.lit("[")), many).otherwise(F.endswith(kind, F.lit("event")))

    return let(F.lower(F.coalesce(F.get_json_object(j, "$['@type']"), F.lit(""))), test)


def event_object(objects: Column) -> Column:
    """The first event among a page's objects, as JSON text; null if none."""
    return F.get(F.filter(objects, is_event_object), F.lit(0))


def at(j: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds anything, as text; empty if none. Lists stand for their first element."""
    return present(*[meaningful(F.get_json_object(j, p)) for p in paths])


def structured_place(j: Column) -> Column:
    """text, venue, city, state, country of an event's location, which is a text, an object or a list of them."""

    def read(loc: Column) -> Column:
        isobj = F.coalesce(F.startswith(F.ltrim(loc), F.lit("{")), F.lit(False))
        field = lambda *p: F.when(isobj, at(loc, *p)).otherwise("")
        address = F.get_json_object(loc, "$.address")
        flat = F.when(isobj & ~F.coalesce(F.startswith(F.ltrim(address), F.lit("{")), F.lit(False)), meaningful(address)).otherwise("")
        parts = F.array(
            field("$.name"), flat, field("$.address.streetAddress"), field("$.address.addressLocality"), field("$.address.addressRegion"),
            field("$.address.addressCountry.name", "$.address.addressCountry"),
        )

        def named(p: Column) -> Column:
            joined = F.array_join(F.filter(p, lambda x: x != ""), ", ")
            return F.struct(F.when(isobj, joined).otherwise(meaningful(loc)).alias("text"), *[F.get(p, F.lit(k)).alias(n) for k, n in ((0, "venue"), (3, "city"), (4, "state"), (5, "country"))])

        return let(parts, named)

    return let(F.coalesce(F.get_json_object(j, "$.location[0]"), F.get_json_object(j, "$.location"), F.lit("")), read)
