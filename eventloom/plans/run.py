"""The whole run: listings and feeds to candidates, candidates to verified events, the new ones delivered and remembered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import report
from eventloom.operators.durable import bounded, durable
from eventloom.operators.select import gate_counts, top_rows
from eventloom.operators.sink import PAUSE, delivery_results
from eventloom.sources import registry
from eventloom.sources.sent import reject
from eventloom.sources.state import write_state
from eventloom.plans.collect import link_candidates, page_links, unique_candidates
from eventloom.plans.pipeline import ALERTS, gates_and_events
from eventloom.plans.search_plan import PAGES, search_urls


def source_listings(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Fetched pages (url, status, html; with part, where listings come in numbered parts) of the direct sources, then of
    the first search queries: ord, url, source, part, html."""
    direct = registry.enabled(registry.direct_sources(spark)).select("ord", "url", "source")
    pages_of = F.create_map(*[F.lit(x) for k, (name, _) in enumerate(PAGES) for x in (name, k)])
    searched = search_urls(spark).select((F.lit(len(registry.DIRECT)) + F.col("ord") * len(PAGES) + pages_of[F.col("name")]).cast("int").alias("ord"), "url", F.col("name").alias("source"))
    part = F.col("part") if "part" in pages.columns else F.lit(0)
    # The registry is a few addresses; parts are dealt over the tasks, each of which parses its own.
    return pages.where("status = 200").select("url", part.cast("long").alias("part"), "html").join(F.broadcast(direct.unionByName(searched)), "url")


def collect_all(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw candidates, unique candidates) of all source listings. The links are cut from their plan: the rules that pick
    candidates name an address many times, and the planner would write out how it was resolved and cleaned each time."""
    links = durable(page_links(bounded(source_listings(spark, pages))))
    raw = durable(link_candidates(links))
    return raw, unique_candidates(raw)


@dataclass
class Run:
    """What a run leaves: tables, and the addresses that were delivered."""

    events: DataFrame
    gates: DataFrame
    sizes: DataFrame
    deliveries: DataFrame
    sent: list[str]


def run_pipeline(spark: SparkSession, listings: DataFrame, pages: DataFrame, sent: DataFrame, today: Column, send: Callable[[str], dict | None], state: str | None = None, limit: int = ALERTS, pause: float = PAUSE) -> Run:
    """Collect from ``listings``, verify against ``pages``, deliver at most ``limit`` new events of ``today`` and, with
    ``state``, write what was delivered so far to that file. Each table that is read twice is written once."""
    raw, unique = collect_all(spark, listings)
    candidates = durable(unique.withColumnRenamed("at", "ord"))
    gates, found = gates_and_events(candidates, pages, today)
    events = durable(found)
    fresh = top_rows(reject(events, sent), "verification_score", "ord", limit)
    results = delivery_results(fresh, send, pause)
    delivered = [u for u, status in results if status == "sent"]
    if state and results:
        known = sent.select("url").unionByName(spark.createDataFrame([(u,) for u in delivered], "url string"))
        write_state(known, state)
    deliveries = report.delivery_counts(spark.createDataFrame(results, "url string, status string"))
    return Run(events, gate_counts(gates, F.col("gate")), report.sizes(raw, candidates), deliveries, delivered)
