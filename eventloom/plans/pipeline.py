"""The whole run: candidates to alerts, without network: pages and state are tables, the sink is handed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import dates as D
from eventloom.functions.text import present, strip
from eventloom.operators.durable import durable
from eventloom.operators.select import first_per_key, not_sent, top_rows

from .verify import decide, gate, read_pages, signals

ALERTS = 10


def gated(verified: DataFrame, today: Column) -> DataFrame:
    return verified.withColumn("is_today", D.covers(F.col("detected_dates"), today)).withColumn("gate", gate())


def verified_events(rows: DataFrame, today: Column) -> DataFrame:
    """``ord`` and the 29 event columns of accepted rows, the first of each URL. The candidate's own title, url, source and
    description stand beside what its page says; it fills in for an event address or description that the page lacks."""
    accepted = gated(rows, today).where("gate = 'accepted'")
    events = accepted.select(
        "ord", strip(F.col("candidate_title")).alias("title"), strip(F.col("url")).alias("url"), strip(F.col("source")).alias("source"), strip(F.col("candidate_description")).alias("description"),
        F.col("title").alias("page_title"), F.col("score").alias("verification_score"), "has_registration", "has_date", "has_future_date", "has_location", F.col("has_india").alias("has_india_location"),
        F.col("is_online").alias("has_online_signal"), "detected_dates", present(F.col("event_date"), F.date_format(today, "yyyy-MM-dd")).alias("event_date"), "event_end_date", "event_time", "event_location",
        "event_venue", "event_city", "event_state", "event_country", "event_mode", "event_organizer", "event_type", "event_price", "registration_url",
        present(F.col("final_url"), F.col("url")).alias("event_url"), present(F.col("page_description"), F.col("candidate_description")).alias("event_description"), "is_today",
    ).where("url <> ''")
    return first_per_key(events, F.col("url"), "ord")


def gates_and_events(candidates: DataFrame, pages: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(gate of each candidate, verified events). All candidates are read and decided; what a page says beyond that is kept
    and described of the accepted ones alone, which are few on a day."""
    decided = decide(read_pages(candidates, pages), today)
    own = [c for c in decided.columns if c != "gate"]
    kept = durable(decided.select("gate", F.when(F.col("gate") == "accepted", F.struct(*own)).alias("row")))
    described = durable(signals(kept.where("gate = 'accepted'").select("row.*"), today).drop("text"))
    return kept.select("gate"), verified_events(described, today)


def alerts(events: DataFrame, sent: DataFrame, limit: int = ALERTS) -> DataFrame:
    """The best events that were not delivered before; the rest waits for the next run."""
    return top_rows(not_sent(events, sent), "verification_score", "ord", limit)
