"""Listing pages to candidate links, and feeds to scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import classify as C
from eventloom.functions.html import parse_html
from eventloom.functions.scoring import confidence
from eventloom.functions.text import squeeze, strip
from eventloom.functions.urls import clean_url, is_invalid_link, is_real_event_url, platform, resolved
from eventloom.operators.select import best_per_key, first_per_key


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of pages (ord, url, source, html; status 200 only): ord, part, pos, source, title, url, context. A page
    may come in several rows, numbered by ``part``. A reference that cannot be resolved drops its row alone."""
    fetched = pages.where("status = 200") if "status" in pages.columns else pages
    part = F.col("part") if "part" in pages.columns else F.lit(0)
    links = fetched.withColumns({"page": parse_html("html"), "part": part.cast("long")}).select("ord", F.col("url").alias("base"), "source", "part", F.posexplode("page.links").alias("pos", "link"))
    return links.select("ord", "part", "pos", "source", "base", squeeze(F.col("link.text")).alias("title"), clean_url(resolved(F.col("base"), F.col("link.href"))).alias("url"), F.col("link.context").alias("context"))


def link_candidates(links: DataFrame) -> DataFrame:
    """Links that may be events. The first link of a URL on a page stands for it before relevance is asked, so a first
    irrelevant link hides a later one."""
    usable = links.where((F.col("title") != "") & F.col("url").startswith("http") & (F.col("url") != clean_url(F.col("base")))).where(~is_invalid_link(F.col("title"), F.col("url")) & is_real_event_url(F.col("url")))
    placed = usable.withColumn("at", F.struct("ord", "part", "pos") if "part" in links.columns else F.struct("ord", "pos"))
    first = first_per_key(placed, F.struct(F.col("ord"), F.lower("url")), "at")
    return first.where(C.is_topical_link(F.col("title"), F.concat_ws(" ", "context", "url")) & C.india_relevance(F.col("title"), F.col("context"), F.col("url"))).withColumn(
        "description", F.concat_ws(" ", F.lit("Detected location:"), C.city_collect(F.concat_ws(" ", "title", "context", "url")), F.lit("Platform:"), platform(F.col("url")))
    ).select("at", "source", "title", "url", "description")


def unique_candidates(candidates: DataFrame, order: str = "at") -> DataFrame:
    """Candidates that still pass the link and place rules, the first of each clean URL without its closing slashes."""
    ready = candidates.withColumns({"url": clean_url(F.col("url")), "title": strip(F.col("title"))})
    kept = ready.where(~is_invalid_link(F.col("title"), F.col("url")) & is_real_event_url(F.col("url")) & C.india_relevance(F.col("title"), F.col("description"), F.col("url")))
    return first_per_key(kept, F.regexp_replace("url", "/+$", ""), order)


def collect(listings: DataFrame) -> DataFrame:
    return unique_candidates(link_candidates(page_links(listings)))


def feed_events(items: DataFrame, order: str = "ord") -> DataFrame:
    """Feed items (ord, title, url, snippet) to events of a known place, the most confident of each URL."""
    from eventloom.functions.urls import domain, normalize_url

    possible = items.where(C.is_possible_event(F.col("title"), F.col("snippet"))).withColumn("location", C.city_rss(F.concat_ws(" ", "title", "snippet"))).where("location <> 'Unknown' and title <> '' and url <> ''")
    scored = possible.withColumns({"confidence": confidence(F.col("title"), F.col("snippet"), F.col("location"), F.col("url")), "source": domain(F.col("url"))})
    return best_per_key(scored, normalize_url(F.col("url")), "confidence", order).orderBy(F.desc("confidence"), "place")
