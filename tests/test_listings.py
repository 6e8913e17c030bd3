"""Listings that come in parts: none is one row, the first link of a page stands for its address over all its parts."""

from pyspark.sql import functions as F

from eventloom.functions.urls import clean_url
from eventloom.plans.collect import link_candidates, page_links
from eventloom.queries import listing_pages


def test_listings_are_cut_into_parts_of_bounded_size(spark):
    events = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("Talk").alias("title"))
    pages = listing_pages(events)
    links = F.size(F.split("html", "<a ")) - 1
    assert pages.agg(F.max(links), F.sum(links)).first()[:] == (250 + 125, 22_500)


def test_the_first_link_over_the_parts_of_a_page_stands(spark):
    html = lambda title: f'<div><a href="https://e.org/t/1">{title} Meetup Pune</a></div>'
    rows = [(0, "https://e.org", "E", 2, html("Malware")), (0, "https://e.org", "E", 1, html("OWASP")), (1, "https://f.org", "F", 0, html("SOC"))]
    listings = spark.createDataFrame(rows, "ord int, url string, source string, part int, html string")
    found = link_candidates(page_links(listings)).select("at.ord", "title").collect()
    assert sorted(map(tuple, found)) == [(0, "OWASP Meetup Pune"), (1, "SOC Meetup Pune")]


def test_a_cleaned_address_names_its_source_once(spark):
    plan = spark.createDataFrame([("a",)], "u string").select(clean_url(F.col("u")).alias("url"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("u#") <= 3 and len(plan) < 20_000
