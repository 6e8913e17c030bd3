"""Scores and the rejection cascade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import text_of
from .urls import trust_of_url

#: Weights of the flags of a verified page; terms that make a feed item more useful.
WEIGHTS = {
    "reachable": 10, "structured": 20, "has_topic": 25, "has_event": 10, "has_date": 10, "has_future_date": 5,
    "has_registration": 5, "has_location": 5, "has_india": 5, "is_topical": 5, "is_event_page": 5,
}
USEFUL = ("register", "registration", "rsvp", "tickets", "venue", "speaker", "speakers", "date")


def verification_score(reason: Column, flags: dict[str, Column]) -> Column:
    """Nothing for a rejected page, else the weights of its flags, 100 at most."""
    total = F.lit(0)
    for name, weight in WEIGHTS.items():
        total = total + F.when(flags[name], weight).otherwise(0)
    return F.when(reason != "", 0).otherwise(F.least(F.lit(100), total)).cast("int")


def confidence(title: Column, snippet: Column, place: Column, url: Column) -> Column:
    both = F.concat_ws(" ", text_of(title), text_of(snippet))
    return F.least(
        F.lit(100),
        F.lit(35) + trust_of_url(url) + F.when(place != "Unknown", 5).otherwise(0) + F.when(place == "Online", 5).otherwise(0)
        + F.when(F.length(title) >= 25, 5).otherwise(0) + F.when(F.length(snippet) >= 100, 5).otherwise(0) + F.least(2 * F.size(L.found(both, USEFUL)), F.lit(10)),
    ).cast("int")


def rejection(listing: Column, topic: Column, event: Column, date: Column, future: Column, mode: Column, india: Column, foreign: Column) -> Column:
    """The first reason that holds; a listing page keeps its own."""
    physical = mode.isin("Offline", "Hybrid") & ~india
    return (
        F.when(listing, "Event listing/index/category page rather than a single individual event")
        .when(~topic, "Not sufficiently cybersecurity related")
        .when(~event, "Not recognized as an event")
        .when(~date, "No reliable individual event date found")
        .when(~future, "Event date is in the past")
        .when(physical & (foreign != ""), F.concat(F.lit("Physical event is outside India ("), foreign, F.lit(")")))
        .when(physical, "Physical/hybrid event location could not be verified as India")
        .when((mode == "Online") & ~india, "Online event has no verified India relevance")
        .otherwise("")
    )
